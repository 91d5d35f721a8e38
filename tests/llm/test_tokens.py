"""Alignment of tokenizers and shards of token ids, against plain versions."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixloom.llm import crosstokens, encoders, wavelet
from helixloom.sources import blobs

ODD = [
    None, "", " ", "a", " a", "a ", "a  b", "a   b", "\n", "a\n b", "a \n b", "a\n\n b", "   b", "é́ ê", "<|endoftext|> x", "<|StartOfText|>", "<s> </s>", "<0x41> ", "▁", "a▁b", " ▁ ", "日本語 テスト", "🙂🙂 🙂",
    "it's we'll  o'clock", "x" * 3000, "= " * 50, "\t\tfoo\tbar ", "a b", "a   b", "\x00 \x01", "12345 67890.", "-----" * 40, "a\x1c b", "J̌. İ. ΑΣ. K", "End.\nNext, (word): ok?! ...", "word²,", "Ⅷ.",
]


def odd_texts(n=400):
    rng = random.Random(3)
    some = ["a", "b", " ", "  ", "\n", " ", "'s", "é", "🙂", "▁", "=", "1", "the", " of", "\t", "　", "\x1c", "<s>", ".", ",", "!", "<|endoftext|>", "É", "Qu"]
    return ODD + ["".join(rng.choice(some) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def byte_level():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def aligned_plainly(docs):
    a_of, b_of, letters = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), byte_level()
    a_of.encode_special_tokens = True
    per, pairs = [], collections.Counter()
    for d, text in docs:
        groups, a, b = [], [], []
        if text:
            a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
            raw_a = [bytes(letters[c] for c in a_of.id_to_token(i)) for i in a]
            raw_b = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends = [list(itertools.accumulate(map(len, x))) for x in (raw_a, raw_b)]
                low = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    groups.append([[t for t, e in zip(ids, end, strict=True) if low < e <= cut] for ids, end in zip((a, b), ends, strict=True)])
                    low = cut
            else:
                a, b = [], []
        per.append((d, len(a), len(b), groups))
        pairs.update({(x, y) for g, h in groups for x in g for y in h})
    best = collections.Counter()
    for (x, _), n in pairs.items():
        best[x] = max(best[x], n)
    out = []
    for d, n_a, n_b, groups in per:
        links = [(x, y) for g, h in groups for x in g for y in h]
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((d, n_a, n_b, len(groups), len(links), sum(pairs[k] == best[k[0]] for k in links), sum(pairs[k] for k in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def both():
    return crosstokens.Files(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("plain", [1 << 12, 3])
def test_alignment_against_a_plain_version(spark, monkeypatch, plain):
    docs = [(i, t) for i, t in enumerate(odd_texts(300 if plain > 3 else 40))] + [(None, "no id here"), (None, "no id here"), (7, "twice")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "chunk": F.lit(2), "pairs": F.lit("x")}).repartition(3)
    if plain == 3:  # in this process, so that the limit holds where it is used
        pair, texts = both()(), [t for _, t in docs]
        whole = crosstokens._slice(pair, crosstokens.pa.array(texts))
        monkeypatch.setattr(crosstokens, "PLAIN_LINKS", plain)
        pieces = crosstokens._slice(pair, crosstokens.pa.array(texts))
        assert all(np.array_equal(x, y) for x, y in zip(whole[0][:4] + list(whole[1:]), pieces[0][:4] + list(pieces[1:]), strict=True)) and whole[0][4] == pieces[0][4]
        return
    got = sorted((tuple(r) for r in crosstokens.counted(df, both(), chunk_bytes=2000).collect()), key=repr)
    assert got == aligned_plainly(docs)


def test_words_are_aligned_once_for_a_worker(monkeypatch):
    monkeypatch.setattr(crosstokens, "CACHE_WORDS", 300)
    monkeypatch.setattr(crosstokens, "JOINED_WORDS", 7)
    pair, asked = both()(), []
    for side in "_a", "_b":
        monkeypatch.setattr(pair, side, lambda texts, f=getattr(pair, side): asked.extend(x for t in texts for x in t.split(" ")) or f(texts))
    rng = random.Random(4)
    rare = ["ﬁn", "x\x00y", "e\u0301t\u0301e", "＃a", "½", "\u200bz", "＝＝"]
    word = lambda: rng.choice(rare) if rng.random() < 0.02 else "".join(rng.choice("abcde,.é🙂") for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(400)] + ["often seen, often read"] * 50 + [None, ""]
    texts += odd_texts(100)
    whole = {texts[d]: (*row, digest) for d, *row, _, _, digest in aligned_plainly(list(enumerate(texts)))}
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        per, of, pairs, times = crosstokens._slice(pair, crosstokens.pa.array(some, "string"))
        assert list(zip(*[x.tolist() for x in per[:4]], per[4], strict=True)) == [whole[t] for t in some]
        assert np.bincount(of, times, len(some)).tolist() == per[3].tolist() and len(set(zip(of.tolist(), pairs.tolist(), strict=True))) == len(of)
    assert len(pair.known.place) <= 600 and asked.count("often") <= 8


def test_alignment_of_empty_tables(spark):
    assert crosstokens.counted(spark.createDataFrame([], "doc_id long, text string"), both()).collect() == []
    assert [tuple(r) for r in crosstokens.counted(spark.createDataFrame([(1, None)], "doc_id long, text string"), both()).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_words_that_were_seen_once_are_forgotten():
    asked = []
    cache = encoders.Words(lambda words: asked.extend(words) or [[len(w), len(w) + 1][: len(w) % 3] for w in words], most=8)
    rng = random.Random(2)
    for _ in range(200):
        words = ["often" if rng.random() < 0.4 else "w" * rng.randrange(30) for _ in range(6)]
        flat, bounds = cache.ids(encoders.pa.array(words))
        assert [flat[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [[len(w), len(w) + 1][: len(w) % 3] for w in words]
    assert len(cache.place) <= 14 and asked.count("often") < 30


def shards_plainly(docs):
    tokenizer, at, out = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for d, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def encoded_plainly(tokenizer, texts):
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


@pytest.mark.parametrize("joined", [1024, 3, 1])
def test_words_of_letters_go_to_the_library_as_one_text(monkeypatch, joined):
    asked, ids = [], wavelet.Encoder._ids
    monkeypatch.setattr(wavelet.Encoder, "_ids", lambda self, texts: asked.extend(texts) or ids(self, texts))
    monkeypatch.setattr(wavelet, "JOINED_WORDS", joined, raising=False)
    encoder = wavelet.WordTokenizer(P.path("word_bpe_49k.json"))()
    rng = random.Random(5)
    new = ["".join(rng.choice("abcdeéñßж日") for _ in range(rng.randint(4, 12))) for _ in range(3000)] + [c * 5000 for c in "abcde"]
    texts = [" ".join(w + rng.choice(["", "", ".", "%%%", "'", '")']) for w in new[i : i + 30]) for i in range(0, len(new), 30)]
    flat, bounds = encoder.encode(encoders.pa.array(texts))
    assert [flat[a:b].tolist() for a, b in itertools.pairwise(bounds)] == encoded_plainly(encoder.tokenizer, texts)
    assert joined < 1024 or len(asked) < 100
    assert max(len(t) for t in asked) < 20_000


@pytest.mark.parametrize("joined", [1024, 2])
def test_letters_that_are_composed_of_a_letter_and_a_mark(monkeypatch, joined):
    monkeypatch.setattr(wavelet, "JOINED_WORDS", joined, raising=False)
    odd = ["\u0958", "\ufb4b", "\u0130", "\u212b", "\u1e9b", "e\u0301", "\u1100", "\u1161", "\u11a8", "\u3000", "\x85", "\x1c", "\u200b", "\u00b2", "\U0001df25", "\U0001e030", "\ua7cd", "\u0338", "\u02bc", "\u03a3"]
    ends = [".", "!", "%%%", "'", "''", "\"", "'s", "'s'", "</w>", "<", ">", "=", "_", "-", "`", "~^", "$1", "\u0338", ""]
    rng = random.Random(6)
    texts = [o + e for o in odd for e in ends] + ["a" + o + "b" + e for o in odd for e in ends]
    texts += [" ".join(rng.choice([*odd, "plain", "words"]) + rng.choice(["", "", "x"]) + rng.choice(ends) for _ in range(20)) for _ in range(100)]
    encoder = wavelet.WordTokenizer(P.path("word_bpe_49k.json"))()
    for some in (texts, texts[::-1], [t for t in texts for _ in range(2)]):
        flat, bounds = encoder.encode(encoders.pa.array(some))
        assert [flat[a:b].tolist() for a, b in itertools.pairwise(bounds)] == encoded_plainly(encoder.tokenizer, some)


@pytest.mark.parametrize("shard_tokens", [1 << 20, 40])
def test_shards_against_a_plain_version(spark, tmp_path, shard_tokens):
    docs = list(enumerate(odd_texts()))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"at": F.lit(1), "place": F.lit(2), "mark": F.lit("x")}).repartition(3)
    path = str(tmp_path / "shards")
    maker = wavelet.WordTokenizer(P.path("word_bpe_49k.json"))
    wavelet.write(df, path, maker, shard_tokens)
    assert sorted(map(tuple, wavelet.read(spark, path).collect()), key=lambda r: r[1]) == shards_plainly(docs)
    assert blobs.read(spark, path).count() > (4 if shard_tokens == 40 else 0)
    text = {d: [*maker().tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    tokens = [1, 49407, text[3][0], 40_000, 1 << 20]
    want = sorted((t, d, i) for d, ids in text.items() for i, x in enumerate(ids) for t in tokens if t == x)
    assert sorted(map(tuple, wavelet.occurrences(spark, path, tokens).collect())) == want


def test_shards_of_shared_and_missing_ids(spark, tmp_path):
    docs = [(5, "b"), (5, "b"), (5, None), (9, ""), (None, "z"), (None, "z"), (-3, "first words")]
    path = str(tmp_path / "x")
    maker = wavelet.WordTokenizer(P.path("word_bpe_49k.json"))
    wavelet.write(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), path, maker)
    got = sorted((tuple(r) for r in wavelet.read(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [-3, 5, 5, 5, 9, None, None] and [r[1] for r in got] == list(itertools.accumulate([r[2] for r in got], initial=0))[:-1]
    assert sorted(r[3] for r in got) == sorted(r[3] for r in shards_plainly(docs))
    wavelet.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), maker)
    assert wavelet.read(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize(("n", "width", "most"), [(0, 4, 9), (1, 1, 1), (5000, 16, 49_408), (100_000, 3, 5), (3000, 20, 1 << 20)])
def test_wavelet_matrix(n, width, most):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), most) - 1 if n else np.zeros(0, np.int64)
    shard = wavelet.Shard(wavelet.to_file([3, None], [n, 0], ids.astype(np.int32), 7, width))
    assert (shard.ids() == ids).all() and shard.first == 7 and shard.known.tolist() == [1, 0]
    for at in rng.integers(0, n, 20) if n else []:
        assert shard.access(int(at)) == ids[at]
        assert shard.count(int(ids[at])) == (ids == ids[at]).sum() and shard.count(int(ids[at]), int(at)) == (ids[:at] == ids[at]).sum()
    for token in set(ids[:5].tolist()) | {most - 1}:
        assert list(itertools.islice(shard.occurrences(token), 50)) == np.flatnonzero(ids == token)[:50].tolist()
    with pytest.raises(ValueError, match="not a shard"):
        wavelet.Shard(b"other")
