"""Token ids by the public tokenizers of the ``tokenizers`` library, memoised by chunk.

``word_bpe_49k`` lower-cases, drops white space and never merges across it, so the ids of a
text are those of its space-separated chunks, one after the other. The distinct chunks of a batch
of texts are looked up in a memo of two generations. A chunk of printable ASCII and letters of Latin-1, which normalisation
only lower-cases, is cut into the pieces that the tokenizer's own pattern makes (runs of letters
or signs, digits). They recur more often than chunks, so they have a memo too; the library's
model tokenises new ones. What else a batch of texts lacks (all chunks, where a tokenizer has other rules)
is joined by spaces, encoded whole in one call and dealt back by its offsets.
Numbers of entries and lengths of keys are bounded: some 100 MB, whatever the corpus.

Ids are little-endian and unsigned, of 16 bits where the vocabulary allows it, else of 32.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

TOKENIZER = "word_bpe_49k.json"
#: Chunks seen twice that a memo holds, chunks seen once, pieces, and bytes of the longest chunk.
MEMO_ROWS, MEMO_NEW, MEMO_PIECES, MEMO_BYTES = 200_000, 150_000, 150_000, 64
#: Bytes of texts that are encoded together.
BATCH_BYTES = 1 << 20
_ENCODERS: dict[str, ChunkEncoder] = {}
#: The rules under which plain chunks are in lower case cut by PIECE.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PLAIN = re.compile(r"[ -~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 ]+| ")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for the tokenizer file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def batches_of(texts: Iterable[bytes | None]) -> Iterator[list[bytes | None]]:
    """``texts`` in lists of about BATCH_BYTES."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or b"")
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


class Memo(dict):
    """The ids of chunks seen twice, in two generations, and of some seen once; None for others."""

    def __init__(self):
        super().__init__()
        self._before, self._once = {}, {}

    def __missing__(self, chunk: bytes) -> bytes | None:
        ids = self._once.pop(chunk, None)
        if ids is None:
            ids = self._before.get(chunk)
        if ids is not None:
            self[chunk] = ids
        return ids

    def add(self, found: dict[bytes, bytes], counts: dict[bytes, int]) -> None:
        if len(self._once) > MEMO_NEW:
            self._once.clear()
        if len(self) > MEMO_ROWS:
            self._before = self.copy()
            self.clear()
        for chunk, ids in found.items():
            if len(chunk) <= MEMO_BYTES:
                (self if counts[chunk] > 1 else self._once)[chunk] = ids


class ChunkEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        #: Bytes of an id; one with all bits set is none of the vocabulary's.
        self.width = 2 if vocabulary < 1 << 16 else 4
        self._known = Memo()
        rules = [x and json.loads(x.__getstate__()) for x in (self._tokenizer.normalizer, self._tokenizer.pre_tokenizer)]
        self._cuts = rules == [NORMALIZER, {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}]
        if self._cuts:
            # The model reads bytes as characters of its own; for ASCII these are the same.
            self._letters = {k: self._tokenizer.pre_tokenizer.pre_tokenize_str(chr(k))[0][0] for k in range(0xDF, 0x100) if PLAIN.fullmatch(chr(k))}
            self._bytes = [k.to_bytes(self.width, "little") for k in range(vocabulary)]
            self._pieces: dict[str, bytes] = {}

    def _cut(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each of ``chunks``, all plain, by way of their pieces."""
        import numpy as np

        none = b"\xff" * self.width
        cut = PIECE.findall(b" ".join([*chunks, b""]).decode("utf-8").lower())
        pieces, tokenise, own = self._pieces, self._tokenizer.model.tokenize, self._bytes
        if len(pieces) > MEMO_PIECES:
            pieces.clear()
        pieces[" "] = none
        for piece in set(cut).difference(pieces):
            pieces[piece] = b"".join([own[x.id] for x in tokenise(piece if piece.isascii() else piece.translate(self._letters))])
        data = b"".join(map(pieces.__getitem__, cut))
        ends = (np.flatnonzero(np.frombuffer(data, dtype=f"<u{self.width}") == int.from_bytes(none)) * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *[x + self.width for x in ends[:-1]]], ends, strict=True)]

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each of ``chunks``, encoded whole."""
        import numpy as np

        parts = [x.decode("utf-8") for x in chunks]
        found = self._tokenizer.encode(" ".join(parts), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
        starts = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
        cut = (np.searchsorted(starts, ends, side="left") * self.width).tolist()
        data = np.array(found.ids, dtype=f"<u{self.width}").tobytes()
        return [data[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def _encoded(self, counts: dict[bytes, int]) -> list[bytes]:
        """The ids of chunks, which the memo lacks; ``counts`` tells how often a batch has them."""
        plain, whole = list(counts), []
        text = b" ".join(plain).decode("utf-8")
        if not self._cuts or not PLAIN.fullmatch(text) or "<|" in text:
            whole = [x for x in plain if not self._cuts or b"<|" in x or not PLAIN.fullmatch(x.decode("utf-8"))]
            plain = list(counts.keys() - set(whole))
        out = {}
        for chunks, ids in ((plain, self._cut), (whole, self._ids)):
            for at in range(0, len(chunks), 1 << 14):
                some = chunks[at : at + (1 << 14)]
                out.update(zip(some, ids(some), strict=True))
        self._known.add(out, counts)
        return [out[x] for x in counts]

    def encode(self, texts: Iterable[bytes | None]) -> list[bytes]:
        """The ids of each UTF-8 text, as bytes."""
        return [ids for some in batches_of(texts) for ids in self._batch(some)]

    def _batch(self, texts: list[bytes | None]) -> list[bytes]:
        """Distinct chunks of the batch are looked up, what is not known encoded together, and all put in their places."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # A-Z in lower case are fewer chunks; special tokens are told by their case.
        lower = pa.array([(x.lower() if b"<|" not in x else x) if x else b"" for x in texts], pa.large_binary())
        split = pc.ascii_split_whitespace(lower.view(pa.large_string()))
        coded, begins = split.values.dictionary_encode(), split.offsets.to_numpy()
        del lower, split  # a worker holds little beside its memo
        chunks = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self._known.__getitem__, chunks))
        gaps = [k for k, x in enumerate(ids) if x is None]
        if gaps:
            counts = np.bincount(coded.indices.to_numpy(), minlength=len(chunks))[gaps].tolist()
            for k, x in zip(gaps, self._encoded(dict(zip([chunks[k] for k in gaps], counts, strict=True))), strict=True):
                ids[k] = x
        _, offsets, data = pa.array(ids, pa.large_binary()).take(coded.indices).buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[begins].tolist()
        return [data[a:b].to_pybytes() for a, b in pairwise(ends)]
