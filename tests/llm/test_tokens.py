import random

import pytest

pytest.importorskip("larkspur.llm")
pytest.importorskip("public_tokenizers")

from larkspur.llm import tokens  # noqa: E402

ASCII = [chr(k) for k in range(0x21, 0x7F)]
LATIN = [chr(k) for k in range(0xC0, 0x100)]
OTHER = ["é", "İ", "Σσ", "K", "ª", "µ", " ", "\u0085", "中", "\U0001f600", "\x00", "\x1f", "\x7f", "×", "÷", "<|endoftext|>", "<|"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def own_ids(library, text, width=2):
    return b"".join(k.to_bytes(width, "little") for k in library.encode(text, add_special_tokens=False).ids)


def texts(seed):
    rng = random.Random(seed)
    parts = [*ASCII, *LATIN, *["'s", "'T", "'re", "'VE", "'m", "'ll", "'d"] * 4, *"etaoinshrdlu" * 8, *" \t\n\r\x0b\x0c" * 4]
    out = ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(3000)]
    out += ["".join(rng.choices([*parts, *OTHER * 4], k=rng.randrange(1, 60))) for _ in range(1000)]
    return out


def test_ids_are_the_librarys_for_every_pair_of_plain_characters(library):
    plain = [*ASCII, *LATIN]
    own = tokens.ChunkEncoder(tokens.tokenizer_path())
    cases = [a + b for a in plain for b in plain] + [f"x{a}x" for a in plain]
    assert own.encode([x.encode() for x in cases]) == [own_ids(library, x) for x in cases]


@pytest.mark.parametrize("bounds", [{}, {"MEMO_ROWS": 20, "MEMO_NEW": 20, "MEMO_PIECES": 20, "MEMO_BYTES": 6, "BATCH_BYTES": 300}])
def test_ids_are_the_librarys_whatever_the_memo_holds(library, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(tokens, name, value)
    own, cases = tokens.ChunkEncoder(tokens.tokenizer_path()), [*texts(1), None, "", " \n", "'", "x" * 5000, "ß" * 300]
    want = [own_ids(library, x or "") for x in cases]
    for _ in range(2):
        assert own.encode([x and x.encode() for x in cases]) == want


def test_plain_chunks_go_by_their_pieces_and_only_others_are_encoded_whole(monkeypatch):
    own, whole = tokens.ChunkEncoder(tokens.tokenizer_path()), []
    encoded = own._ids
    monkeypatch.setattr(own, "_ids", lambda chunks: whole.extend(chunks) or encoded(chunks))
    own.encode(["zorbly, Zorbly. zorbly## Été!".encode(), "(zorbly) 中 zorbly中 <|x".encode()])
    assert sorted(x.decode() for x in whole) == ["<|x", "zorbly中", "中"]
    own.encode(["été, zorbly; '".encode()])
    assert len(whole) == 3 and {"zorbly", "été", ",", "##", "'"} <= set(own._pieces) and not any("zorbly" in x for x in own._pieces if x != "zorbly")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_rules_of_another_tokenizer_are_not_taken_for_these(name):
    assert not tokens.ChunkEncoder(tokens.tokenizer_path(name))._cuts
