import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

pytest.importorskip("larkspur.llm")

from larkspur.llm import leaks  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, length=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - length + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + length]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                own = windows.get(tuple(w[k : k + m]))
                if own:
                    hit.update(range(k, k + m))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append(str((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))))
    return sorted(out)


def fixture(seed=11):
    rng = random.Random(seed)
    vocabulary = ["the", "Cat", "niño", "42", "été", "dog", "x", "日本", "runs", "b2", "OVER", "fox"]

    def text(n, words=vocabulary, marks=" ,.\n-"):
        return "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))

    items = [(k, text(rng.randrange(10, 40))) for k in range(30)]
    items += [(100, "Short one here"), (101, "single"), (102, None), (103, " .,! "), (104, items[0][1]), (0, items[1][1]), (None, "null id words are hit all ten of them yes eleven"), (105, "dog dog")]
    foreign = [*vocabulary, "foreign", "words", "apart"]
    docs = [(k, text(rng.randrange(0, 200), foreign)) for k in range(60)]
    for k in range(40):
        item = rng.choice(items)[1] or ""
        docs.append((1000 + k, text(rng.randrange(0, 50), foreign) + " " + item.upper().replace("É", "é").replace("Ñ", "ñ") + " " + text(rng.randrange(0, 50), foreign)))
    docs += [(2000, None), (2001, ""), (2002, "!?"), (2003, "a short one here, SINGLE"), (None, "single"), (5, docs[5][1]), (2004, "dog " * 3000), (2005, "null id words are hit all ten of them yes")]
    docs += [(3000 + k, docs[65][1]) for k in range(100)]  # copies
    return docs, items


def run(spark, docs, items, tmp_path, parts=3):
    spark.createDataFrame([(t, 0, i, "n") for i, t in docs], "text string, row int, doc_id bigint, spans string").repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t, i, 1) for i, t in items], "text string, item_id bigint, block int").write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted(str(tuple(r)) for r in leaks.op11_fm_index(spark, str(tmp_path)).collect())


def test_against_plain_search_and_sql(spark, tmp_path):
    docs, items = fixture()
    want = plain(docs, items)
    assert run(spark, docs, items, tmp_path) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(str(r) for r in con.sql(leaks.OP11_SQL).fetchall()) == want


def test_small_shards_and_blocks(spark, tmp_path, monkeypatch):
    docs, items = fixture(2)
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(leaks, "SHARD_DOCUMENTS", 7)
    assert leaks._blocks(spark.createDataFrame(items, "item_id bigint, text string"))[1] > 2
    assert run(spark, docs, items, tmp_path, 2) == plain(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], []), ([(1, "a b")], [(1, None), (2, "...")]), ([(1, None)], [(1, "a")]), ([], [])])
def test_small_tables(spark, tmp_path, docs, items):
    assert run(spark, docs, items, tmp_path, 1) == plain(docs, items)


def test_cleaned_texts(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two three! And this", 7), (2, "nothing", 8), (3, None, 9), (4, "one TWO-three", 0)], "doc_id bigint, text string, spans int")
    items = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    got = {r.doc_id: (r.text, r.spans) for r in leaks.cleaned(docs, items).collect()}
    assert got == {1: ("Keep this. ! And this", 7), 2: ("nothing", 8), 3: (None, 9), 4: ("", 0)}
    assert leaks.cleaned(docs, items).columns == docs.columns


def test_suffix_array_and_index():
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 4, rng.integers(1, 60)) for _ in range(40)] + [np.ones(300, dtype=np.int64)] * 3
    symbols = np.concatenate([np.append(t, 0) for t in texts])
    ends = iter(range(-len(texts), 0))
    marked = [int(s) if s else next(ends) for s in symbols]  # every end is its own symbol, in order
    want = sorted(range(len(symbols)), key=lambda k: marked[k:])
    assert leaks.suffix_array(symbols).tolist() == want
    index = leaks.FMIndex(symbols, sample=5)
    text = "".join(map(str, symbols))
    for _ in range(200):
        m = int(rng.integers(1, 6))
        pattern = rng.integers(1, 5, (1, 6))
        pattern[0, : 6 - m] = 0
        low, high = index.search(pattern, np.array([m]))
        wanted = "".join(map(str, pattern[0, 6 - m :]))
        places = [k for k in range(len(text)) if text.startswith(wanted, k)]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == places
