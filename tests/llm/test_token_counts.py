"""The compiled transducer against the library, on texts and on chunks of them."""

import random

import pytest

from adsift.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, digest int, n_tokens string"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(2)
    odd = "ab  ▁\n\t<s></s>éßñ日本語中文한국어😀0123xyzTHE the  in Á́\x00\x01\ufeff"
    plain = "aehinorst .,"
    made = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 300))) for _ in range(500)]
    made += ["a" * n for n in range(60)] + [" " * n for n in range(60)]
    return made + ["", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "ab▁cd", "é", "e\u0301", "\r\n\r\n", "𝕏 😀😀"]


def test_counts_are_those_of_the_library(library):
    machine = token_counts.transducer(MODEL)
    every = texts() + list(machine.pieces.rank)[::37]
    assert [machine.count(t) for t in every] == [len(x) for x in library.encode(every)]


@pytest.mark.parametrize("size,look", [(64, 40), (9, 4), (200, 64)])
def test_chunks_compose_in_any_way(library, size, look):
    machine = token_counts.transducer(MODEL)
    rng = random.Random(3)
    resolved = 0
    every = texts()[::7] + ["nonewlinehere" * 40, "line\nline two\n" * 20, "a" * 700, "ab" * 300, "=" * 500]
    for text in filter(None, every):
        chunks = token_counts.cut(token_counts.marked(text), size, look)
        maps = [machine.chunk_map(chunk, border, look) for chunk, border in chunks]
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [token_counts.composed(maps[i : i + 2])]
        (steps,) = maps
        if steps:
            resolved += 1
            assert steps[0][1] == len(library.encode(text))
    if look > 30:
        assert resolved == len(every) - every.count("")


def test_maps_are_small_however_long_the_text(library):
    machine = token_counts.transducer(MODEL)
    rng = random.Random(4)
    text = "".join(rng.choice("aehinorstlduc ") for _ in range(1 << 20))  # every character is in some piece
    assert all(c in machine.pieces.trie for c in token_counts.marked(text))
    maps = [machine.chunk_map(chunk, border) for chunk, border in token_counts.cut(token_counts.marked(text))]
    assert len(maps) == 33
    assert max(len(m) for m in maps) <= token_counts.BEFORE + 1
    assert sum(len(m) for m in maps) < 40
    assert token_counts.composed(maps)[0][1] == len(library.encode(text))


def test_a_text_without_a_composed_map_is_read_from_its_beginning(spark, library, monkeypatch):
    text = "The quick brown fox's tail " * 4000
    docs = spark.createDataFrame([(1, text, 1, "x"), (2, text + "!", 1, "x"), (1, text, 1, "x")], SCHEMA)
    monkeypatch.setattr(token_counts, "_steps", lambda maps, made=token_counts._steps: made([[] for _ in maps]))
    found = sorted(map(tuple, token_counts.count_tokens(docs, MODEL).collect()))
    n = len(library.encode(text)), len(library.encode(text + "!"))
    assert found == [(1, len(text), n[0]), (1, len(text), n[0]), (2, len(text) + 1, n[1])]


def test_forgotten_states_are_compiled_again(library):
    machine = token_counts.Transducer(token_counts.transducer(MODEL).pieces, most=50)
    some = texts()[::11]
    assert [machine.count(t) for t in some] == [len(x) for x in library.encode(some)]


def test_documents_long_and_short(spark, library, monkeypatch):
    long = "The quick brown fox's\n" * 4000 + "x" * 70000 + "日本 " * 20000
    rows = [(i, t) for i, t in enumerate(texts()[::9])]
    rows += [(900, long), (900, long), (901, long + "!"), (None, long), (None, None), (None, "a"), (5, None), (5, "twice"), (5, "twice")]
    rows += [(903, "no line break " * 180_000)]  # more chunks than are composed at once
    rows += [(902, "a" * (token_counts.CHUNK + d)) for d in (-2, -1, 0, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    found = token_counts.count_tokens(docs, MODEL).collect()
    wanted = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_no_documents(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), MODEL).collect() == []
