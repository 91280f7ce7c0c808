"""Benchmark decontamination: an FM-index for each shard of training text, searched backward.

A shard is as many documents of a partition as give SHARD symbols or so. Its words become
symbols: the ranks of the benchmark's words, and an end mark for each stretch of foreign words; a
stretch of known words that is shorter than the shortest window cannot hold one and is not
indexed. The shard's suffix array gives its Burrows-Wheeler transform, which a wavelet matrix of
bits holds with ranks by counted blocks. All windows are searched backward at once, a word
at a time, and leave the search when their interval is empty. The rows of an interval walk
back to the next sampled suffix position, which locates the occurrence. Occurrences merge into
spans of words to remove.

A window is ``length`` consecutive words of an item; an item of fewer, but not none, is one
window. Documents are the training side and stay where they are: nothing is shuffled. The
benchmark goes to the tasks in blocks of at most BLOCK_BYTES or so (a larger item is a block of its own);
with several blocks the documents are searched once for each and their spans are merged by row.

Memory of a task: the arrays of one shard, one document's words, one block of the benchmark.

Defined results: null and empty texts have no words; items without words have no windows; items
that repeat a text are all named, rows that repeat an item's id name it once, a null item id is
not named although its words count as hit; repeated documents are judged each on its own;
without items nothing is hit; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

LENGTH = 10
SHARD = 1 << 20
#: Documents of one shard; most have no symbols.
SHARD_DOCUMENTS = 50_000
#: Every so many positions of a shard one is kept in its suffix array.
SAMPLE = 16
BLOCK_BYTES = 16 << 20
#: Bytes of UTF-8: A-Z become a-z; letters, digits and all beyond ASCII belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Bits:
    """A bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits):
        import numpy as np

        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at):
        """Ones before each of ``at``."""
        import numpy as np

        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at):
        import numpy as np

        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet matrix: a bit vector for each bit of the symbols, highest first, stably parted by it."""

    def __init__(self, symbols, most: int):
        import numpy as np

        self.levels = []
        for shift in reversed(range(max(1, int(most).bit_length()))):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol, at):
        """Occurrences of each ``symbol`` before its ``at``."""
        import numpy as np

        low = np.zeros_like(at)
        for shift, bits in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(at)
            low, at = np.where(one, bits.zeros + a, low - a), np.where(one, bits.zeros + b, at - b)
        return at - low

    def get(self, at):
        """(symbol, its occurrences before) at each of ``at``."""
        import numpy as np

        symbol, low, at = np.zeros_like(at), np.zeros_like(at), at.copy()
        for _, bits in self.levels:
            one = bits.get(at)
            symbol = symbol << 1 | one
            a, b = bits.rank(low), bits.rank(at)
            low, at = np.where(one, bits.zeros + a, low - a), np.where(one, bits.zeros + b, at - b)
        return symbol, at - low


def suffix_array(symbols):
    """Suffixes in order, by doubling; zeros end texts and differ, the earlier is the smaller.
    Only suffixes that are still tied are sorted again."""
    import numpy as np

    n = len(symbols)
    open_ = np.argsort(symbols, kind="stable")
    key = symbols[open_]
    head = np.append(True, (key[1:] != key[:-1]) | (key[1:] == 0))[:n]
    place = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    rank[open_] = np.maximum.accumulate(np.where(head, place, 0))
    h = 1
    while True:
        tied = ~(head & np.append(head[1:], True))
        open_ = open_[tied]
        if not len(open_):
            break
        key = rank[open_] * n + rank[open_ + h]  # a tied suffix has not met its end, so there is one behind
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        base, place = rank[open_], np.arange(len(open_))
        old = np.append(True, base[1:] != base[:-1])
        head = np.append(True, key[1:] != key[:-1])
        rank[open_] = base + np.maximum.accumulate(np.where(head, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
        h *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Counts and places of words in ``symbols``, in which zeros end texts and the last one is a zero."""

    def __init__(self, symbols, sample: int = SAMPLE):
        import numpy as np

        most = int(symbols.max(initial=0))
        order = suffix_array(symbols)
        self.n = len(symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=most + 1))])
        self.tree = Wavelet(symbols[order - 1], most)
        # No walk leaves a text: the starts of texts are sampled too.
        kept = (order % sample == 0) | (symbols[order - 1] == 0)
        self.kept, self.samples = Bits(kept), order[kept]

    def search(self, patterns, lengths):
        """(low, high) of each row of ``patterns``, whose last symbols stand at the right."""
        import numpy as np

        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        unknown = (patterns >= len(self.first) - 1).any(axis=1)
        high[unknown] = 0
        for k in range(1, patterns.shape[1] + 1):
            at = np.flatnonzero((lengths >= k) & (low < high))
            if not len(at):
                break
            symbol = patterns[at, -k]
            start = self.first[symbol]
            low[at], high[at] = start + self.tree.rank(symbol, low[at]), start + self.tree.rank(symbol, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows):
        """Positions of the suffixes of ``rows``: steps back until one is sampled."""
        import numpy as np

        out, steps, todo, at = np.zeros(len(rows), dtype=np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            done = self.kept.get(at)
            out[todo[done]] = self.samples[self.kept.rank(at[done])] + steps
            todo, at = todo[~done], at[~done]
            symbol, before = self.tree.get(at)
            at = self.first[symbol] + before
            steps += 1
        return out


def words_of(texts):
    """(ends of the texts' words, all words) of an Arrow array of binary texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.fill_null(b"")
    data = texts.buffers()[2]
    folded = pa.LargeStringArray if pa.types.is_large_binary(texts.type) else pa.StringArray
    folded = folded.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer((data.to_pybytes() if data else b"").translate(FOLD)), None, 0, texts.offset)
    split = pc.ascii_split_whitespace(folded)
    words = split.flatten()
    full = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)])
    offsets = split.offsets.to_numpy()
    return full[offsets[1:] - offsets[0]], words.filter(pc.not_equal(words, ""))


class Windows:
    """Distinct windows of a block of the benchmark as symbols, and the items behind each."""

    def __init__(self, items: list[tuple[str | None, str | None]], length: int):
        import numpy as np
        import pyarrow as pa

        ends, words = words_of(pa.array([None if t is None else t.encode() for _, t in items], pa.binary()))
        self.words = words.unique()  # symbol k + 1 is word k
        symbols = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1 if len(words) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        counts = ends - starts
        rows, owner = [], []
        for k in np.flatnonzero(counts):
            own = symbols[starts[k] : ends[k]]
            found = np.zeros((max(1, len(own) - length + 1), length), dtype=np.int64)
            if len(own) >= length:
                found[:] = np.lib.stride_tricks.sliding_window_view(own, length)
            else:
                found[0, length - len(own) :] = own
            rows.append(found)
            owner += [int(k)] * len(found)
        every = np.concatenate(rows) if rows else np.zeros((0, length), dtype=np.int64)
        self.patterns, which = np.unique(every, axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        pairs = np.unique(np.stack([which.ravel(), np.array(owner, dtype=np.int64)], axis=1), axis=0)
        self.items_from = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))
        self.items = pairs[:, 1]
        self.ids = [i for i, _ in items]


class _Shard:
    """Stretches of known words of some documents, and what is found in them."""

    def __init__(self):
        self.documents, self.symbols, self.stretches = [], [], []
        self.size = 0

    def add(self, document: tuple, symbols, shortest: int) -> None:
        import numpy as np

        known = np.concatenate([[0], (symbols > 0).view(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= shortest:
                self.stretches.append((self.size, len(self.documents), a))
                self.symbols += [symbols[a:b], np.zeros(1, dtype=np.int64)]
                self.size += b - a + 1
        self.documents.append(document)

    def found(self, windows: Windows) -> Iterator[tuple]:
        """(row, doc_id, n_words, spans, items) of each document."""
        import numpy as np

        spans: dict[int, list] = {}
        items: dict[int, list] = {}
        if self.size:
            index = FMIndex(np.concatenate(self.symbols))
            low, high = index.search(windows.patterns, windows.lengths)
            count = high - low
            hit = np.flatnonzero(count)
            count = count[hit]
            window = np.repeat(hit, count)
            inside = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
            at = index.locate(low[window] + inside)
            stretch = np.array(self.stretches, dtype=np.int64)
            of = np.searchsorted(stretch[:, 0], at, side="right") - 1
            document, word = stretch[of, 1], stretch[of, 2] + at - stretch[of, 0]
            order = np.lexsort((word, document))
            for d, a, b in zip(document[order].tolist(), word[order].tolist(), (word + windows.lengths[window])[order].tolist(), strict=True):
                own = spans.setdefault(d, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
            for d, w in np.unique(np.stack([document, window], axis=1), axis=0).tolist():
                items.setdefault(d, []).extend(windows.items[windows.items_from[w] : windows.items_from[w + 1]].tolist())
        for k, (row, doc_id, n) in enumerate(self.documents):
            ids = {windows.ids[x] for x in set(items.get(k, ()))} - {None}
            yield row, doc_id, n, [{"start": a, "end": b} for a, b in spans.get(k, ())], sorted(ids)


def _blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """``benchmark`` as (item_id, text, block) and the number of blocks."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint") + 32), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    if n == 1:
        return items.withColumn("block", F.lit(0)), n
    # Rows of equal items are dealt apart; written once, so that no rerun deals them anew.
    block = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    return scratch.materialize(items.withColumn("block", block), "benchmark"), n


def hits(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, doc_id, n_words, spans, items): spans of words of ``docs`` (doc_id, text) that lie
    inside occurrences of windows of ``benchmark`` (item_id, text), and the items they come from.
    Spans are [start, end) in words; they neither overlap nor touch."""
    import pyarrow as pa

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    items, n = _blocks(benchmark)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    shape = f"row bigint, doc_id {doc_type}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"

    def search(block: int) -> DataFrame:
        own = [tuple(r) for r in items.where(F.col("block") == block).select("item_id", "text").collect()]
        sent = docs.sparkSession.sparkContext.broadcast(Windows(own, length))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np
            import pyarrow.compute as pc

            windows, shard = sent.value, _Shard()

            def flush() -> pa.RecordBatch:
                rows = list(zip(*shard.found(windows), strict=True))
                types = (pa.int64(), id_type, pa.int64(), span, pa.list_(pa.string()))
                return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(rows, types, strict=True)], names=["row", "doc_id", "n_words", "spans", "items"])

            for batch in batches:
                id_type = batch.column("doc_id").type
                ends, words = words_of(batch.column("text"))
                symbols = pc.fill_null(pc.index_in(words, value_set=windows.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                start = 0
                for row, doc_id, end in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    shard.add((row, doc_id, end - start), symbols[start:end], max(1, windows.shortest))
                    start = end
                    if shard.size >= SHARD or len(shard.documents) >= SHARD_DOCUMENTS:
                        yield flush()
                        shard = _Shard()
            if shard.documents:
                yield flush()

        return source.mapInArrow(work, shape)

    found = search(0)
    if n == 1:
        return found
    for block in range(1, n):
        found = found.unionByName(search(block))
    merged = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column("spans").to_pylist():
                own: list[dict] = []
                for s in spans:
                    if own and s["start"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], s["end"])
                    else:
                        own.append(s)
                out.append(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_words")), pa.array(out, span), batch.column("items")], names=["row", "doc_id", "n_words", "spans", "items"])

    return merged.mapInArrow(joined, shape)


def op11_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with its columns, the hit spans cut out of ``text``: from the first byte of a
    span's first word to the last byte of its last word. Texts without hits stay as they are."""
    import pyarrow as pa

    columns, kinds = docs.columns, {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kept = scratch.materialize(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[docs[f"`{c}`"] for c in columns]).alias("doc")), "documents")
    found = hits(kept.select("_row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")).select(F.col("_row").alias("doc_id"), "text"), benchmark, length)
    cuts = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_row"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if spans:
                    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(FOLD))]
                    at, out = 0, b""
                    for s in spans:
                        out += text[at : places[s["start"]][0]]
                        at = places[s["end"] - 1][1]
                    text = out + text[at:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.binary())], names=["doc", "cut"])

    joined = kept.join(cuts, "_row", "left").select("doc", F.col("doc.text").cast("binary").alias("text"), "spans")
    shape = ", ".join(f"`{c}`: {kinds[c]}" for c in columns)
    done = joined.mapInArrow(cut, f"doc struct<{shape}>, cut binary")
    return done.select(*[(F.col("cut").cast("string") if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in columns])


def _sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as (select row_number() over () as r, doc_id, {words} as w from documents),
b as (select item_id, {words} as w from benchmark),
g as (select distinct item_id, array_to_string(list_slice(w, k, k + {LENGTH - 1}), ' ') as g, least(len(w), {LENGTH}) as m from (select *, unnest(range(1, greatest(len(w) - {LENGTH}, 0) + 2)) as k from b where len(w) > 0)),
sizes as (select distinct m from g),
o as (select r, k, m, array_to_string(list_slice(w, k, k + m - 1), ' ') as g from (select r, w, m, unnest(range(1, len(w) - m + 2)) as k from d cross join sizes where len(w) >= m)),
h as (select distinct o.r, o.k, o.m, g.item_id from o join g using (g, m)),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + m)) as p from h) group by r),
i as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from h where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join i using (r)
"""


OP11_SQL = _sql()
