"""Decontamination against a search written from the contract alone."""

import hashlib
import re

from tests.conftest import DATA
from tidelog.llm import decontaminate, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(texts, items):
    windows = {}
    for item, text in items:
        own = words(text)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add("" if item is None else str(item))
    out = {}
    for d, text in texts:
        found, hit, ids = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(found) - n + 1):
                if own := windows.get(tuple(found[i : i + n])):
                    hit |= {*range(i, i + n)}
                    ids |= own
        out[d] = (len(found), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def test_query_equals_a_search_from_the_contract(spark):
    rows = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(key, "text").collect()]
    wanted = plain(rows("documents", "doc_id"), rows("benchmark", "item_id"))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_decontaminate(spark, str(DATA)).collect()}
    assert got == wanted and any(w[4] for w in wanted.values())


def test_made_cases_of_all_lengths_and_blocks(spark):
    items = [(1, "Plain WORDS, in"), (2, ""), (3, None), (None, "emoji"), (4, "word " * 12), (5, "Ärger über naïve ÉCOLE-Wörter 7x"), (6, "plain words in"), (7, "a b c d e f g h i j k l m")]
    texts = [(1, "plain words in a plain text"), (2, None), (3, ""), (4, "word " * 20_000), (5, "x ärger über naïve école wörter 7x"), (6, "Ärger über naïve ÉCOLE-wörter 7X!"), (7, "emoji\x00emoji"), (8, "z a b c d e f g h i j k z b c d e f g h i j k l"), (9, "b c d e f g h i j")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 5):
        got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.find_windows(docs, bench, 10, size)).collect()}
        assert got == plain(texts, items)
