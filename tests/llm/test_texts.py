"""SimHash, token counts, token ids, SentencePiece and mixing against plain definitions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece as library
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstat.llm import mixing, queries, sentencepiece, simhash, tokencount, tokenids

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PIECES = tokencount.public("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n", "a", "A b", "don't  stop\tnow\n\n end  ", "x" * 5000, " leading", "trailing ", "é́ ß İ Σας ΣΑΣ", " no　break s", "emoji 😀👩‍👩 flags 🇩🇪",
    "\x1c\x1d\x85 odd", "<|endoftext|> inside<|endoftext|>x <|startoftext|>", "▁mark ▁▁ marks", "a\r\nb\x0bc\x0cd", "0123456789 " * 40, "\x00zero", "日本語のテキスト 한국어", "s's 't 'LL ''", "....!!!???", "́combining", "a​b﻿c",
]


def fuzz(n=300, seed=1):
    rng = random.Random(seed)
    bits = ["the", " ", "  ", "\n", "\t", "'s", "é", "ß", "Ω", "١", "½", "中", "😀", ".", "...", "▁", "<|endoftext|>", "Th", "ing", "́", " ", "\r\n", "\x0b", "12", "İ", "ﬁ", "word", " ", "-", "_", "\x1f", "᠎"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def frame(spark, texts, source=lambda i: f"src{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def all_texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD + fuzz()


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    least = {}
    for i, f in fps:
        least[f] = min(i, least.get(f, i))
    kinds, parent = list(least), {f: f for f in least}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in range(len(kinds)):
        for b in range(a):
            if (kinds[a] ^ kinds[b]).bit_count() <= 2:
                parent[root(kinds[a])] = root(kinds[b])
    smallest = {}
    for f in kinds:
        smallest[root(f)] = min(least[f], smallest.get(root(f), least[f]))
    return {i: smallest[root(f)] for i, f in fps}


def test_fingerprints(spark, sf):
    texts = all_texts(spark, sf)
    got = {r.id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(frame(spark, texts)).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_simhash_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = plain_components(fps)
    got = queries.op7_simhash(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", want[i]) for i, f in fps)


@pytest.mark.parametrize("bucket", [64, 2])
def test_close_pairs_connect_all_within_two_bits(spark, bucket):
    rng = random.Random(5)
    words = []
    for _ in range(60):
        w = rng.getrandbits(64)
        words.append(w)
        for _ in range(6):
            w ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            words.append(w)
    words = list(dict.fromkeys(words))
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    pairs = simhash.close_pairs(spark.createDataFrame([(w,) for w in signed], "fp long"), bucket).collect()
    parent = {w: w for w in signed}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in pairs:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
        parent[root(a)] = root(b)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert root(a) == root(b)


def test_golay_lists_share_an_index():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 400)
    for w in words.tolist():
        near = [w] + [w ^ (1 << a) ^ (1 << b) for a in range(23) for b in range(a + 1)]
        index, real = simhash.golay_indices(np.array(near))
        own = set(index[0][real[0]].tolist())
        assert all(own & set(index[i][real[i]].tolist()) for i in range(len(near)))


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame([(3, "a b c d", "x"), (3, "a b c d", "y"), (None, "a b c d", "z"), (1, None, "z"), (2, " ", "z"), (None, None, "z")], "doc_id long, text string, id string")
    got = sorted((r.id is None, r.id or 0, r.component) for r in simhash.near_duplicates(df).collect())
    assert got == [(False, 1, 1), (False, 2, 1), (False, 3, 3), (False, 3, 3), (True, 0, 1), (True, 0, 3)]
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_token_counts(spark, sf):
    texts = all_texts(spark, sf)
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = tokencount.public(name)
        got = {r.id: (r.n_bytes, r.n_tokens) for r in tokencount.token_counts(frame(spark, texts), path).collect()}
        if name.endswith(".json"):
            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
        else:
            want = [len(x) for x in library.SentencePieceProcessor(model_file=path).encode([x or "" for x in texts])]
        wrong = [(texts[i], got[i], w) for i, w in enumerate(want) if got[i] != (len((texts[i] or "").encode()), w)]
        assert not wrong, wrong[:3]


def test_token_ids_round_trip(spark, sf, tmp_path):
    texts = all_texts(spark, sf) + ["the same words again " * 3000]
    path = tokencount.public("byte_bpe_50k.json")
    df = frame(spark, texts).orderBy(F.rand(3)).repartition(3)
    tokenids.write(df, str(tmp_path / "t"), path)
    got = sorted(tuple(r) for r in tokenids.read(spark.read.parquet(str(tmp_path / "t"))).select("id", "start", "n_tokens", "ids_crc32").collect())
    t, start, want = Tokenizer.from_file(path), 0, []
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


@pytest.mark.parametrize("keep", [50, 10**6])
def test_stretches_are_remembered_and_forgotten(keep, monkeypatch):
    path = tokencount.public("byte_bpe_50k.json")
    monkeypatch.setattr(tokenids, "KEEP", keep)
    tokenids.pool.cache_clear()
    t, m = Tokenizer.from_file(path), sentencepiece.Model(*sentencepiece.contents(PIECES))
    m.pool.keep = keep
    sp = library.SentencePieceProcessor(model_file=PIECES)
    for seed in range(4):
        texts = [x or "" for x in ODD] + fuzz(60, seed) + ["a plain text\nof two lines " + "word%d" % i + " end" for i in range(80)]
        for got, want in ((tokenids.encode_all(pa.array(texts), path), [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]), (m.encode_all(pa.array(texts)), sp.encode(texts))):
            assert got[1].tolist() == list(map(len, want)) and got[0].tolist() == sum(want, [])
    assert len(m.pool.numbers) <= max(keep, 3000)
    tokenids.pool.cache_clear()


def test_round_trip(spark):
    texts = [t for t in ODD if "▁" not in (t or "")]
    df = frame(spark, texts).withColumn("round_trip", F.lit("clash"))
    got = sentencepiece.round_trip(df, PIECES).collect()
    sp = library.SentencePieceProcessor(model_file=PIECES)
    assert all(r.round_trip is True and r.ids == sp.encode(texts[r.doc_id] or "") for r in got) and len(got) == len(texts)
    assert sentencepiece.round_trip(df.where("false"), PIECES).count() == 0


def test_repair_random_access():
    rng = np.random.default_rng(4)
    ids = np.concatenate((np.tile(rng.integers(0, 50000, 40), 300), rng.integers(0, 20, 9000), np.zeros(3000, int)))
    rules, spans, seq = tokenids.compress(ids)
    assert len(rules) and len(seq) < len(ids) / 2
    assert (tokenids.expand(rules, spans, seq) == ids).all()
    for a, b in [(0, 1), (5, 5), (17, 4000), (len(ids) - 3, len(ids)), (12000, 12001)]:
        assert (tokenids.expand(rules, spans, seq, a, b) == ids[a:b]).all()


def test_token_ids_odd_tables(spark, tmp_path):
    path = tokencount.public("byte_bpe_50k.json")
    df = spark.createDataFrame([(2, "b", 1, 2), (2, "a", 3, 4), (None, "n", 5, 6), (1, None, 7, 8)], "doc_id long, text string, id long, shard long")
    tokenids.write(df, str(tmp_path / "a"), path)
    got = sorted((r.start, r.id, r.n_tokens) for r in tokenids.read(spark.read.parquet(str(tmp_path / "a"))).collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 2, 2), (5, 2, 2)]
    tokenids.write(df.where("false"), str(tmp_path / "b"), path)
    assert tokenids.read(spark.read.parquet(str(tmp_path / "b"))).count() == 0


def test_pieces_equal_the_library(spark, sf):
    texts = all_texts(spark, sf)
    sp = library.SentencePieceProcessor(model_file=PIECES)
    want = sp.encode([t or "" for t in texts])
    rows = sentencepiece.decode(sentencepiece.encode(frame(spark, texts), PIECES), PIECES).collect()
    wrong = [(texts[r.doc_id], r.ids, want[r.doc_id]) for r in rows if r.ids != want[r.doc_id]]
    assert not wrong, wrong[:2]
    assert all(r.decoded == (r.text or "") for r in rows if "▁" not in (r.text or ""))


def test_streamed_blocks_give_the_same_ids():
    m = sentencepiece.model(PIECES)
    sp = library.SentencePieceProcessor(model_file=PIECES)
    text = "".join(t for t in ODD if t) * 3
    whole = "▁" + text.replace(" ", "▁")
    for size in (1, 7, 64, 4096):
        parts = list(m.stream(whole[i : i + size] for i in range(0, len(whole), size)))
        assert np.frombuffer(b"".join(parts), "<i4").tolist() == sp.encode(text)
        assert size > 64 or max(map(len, parts)) < 4 * 5200


def test_unigram_is_the_best_path():
    pieces = ["<unk>", "a", "b", "ab", "abc", "c", "bc", "▁", "▁a"]
    scores = [0.0, -2.0, -2.1, -3.0, -5.5, -2.2, -2.5, -1.0, -2.4]
    m = sentencepiece.Model(pieces, scores, [2, 1, 1, 1, 1, 1, 1, 1, 1], bpe=False)

    def best(t):
        at = [(0.0, [])]
        for n in range(1, len(t) + 1):
            options = [(at[i][0] + scores[pieces.index(t[i:n])], at[i][1] + [t[i:n]]) for i in range(n) if t[i:n] in pieces]
            if t[n - 1 : n] not in pieces:
                options.append((at[n - 1][0] + min(scores[1:]) - 10, at[n - 1][1] + ["<unk>"]))
            at.append(max(options, key=lambda o: o[0]))
        return [pieces.index(p) for p in at[-1][1]]

    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("abc z") for _ in range(rng.randrange(1, 80)))
        got = m.encode_all(pa.array([text]))[0].tolist()
        assert got == best("▁" + text.replace(" ", "▁"))


def test_existing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, ids int, score string")
    got = sentencepiece.encode(df, PIECES).collect()[0]
    assert got.asDict().keys() == {"doc_id", "text", "ids", "score"} and got.ids == library.SentencePieceProcessor(model_file=PIECES).encode("a b")
    assert sentencepiece.encode(df.where("false"), PIECES).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in order if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > most * sizes[s]] if rest else []
        if not over:
            return full | {s: left * weight[s] / total for s in rest}
        for s in over:
            full[s] = most * sizes[s]
        left = float(sum(sizes.values())) - sum(full.values())


def test_mixing(spark):
    rng = random.Random(3)
    texts = [" ".join("w" for _ in range(int(rng.paretovariate(0.9)))) for _ in range(3000)] + [None, "", " "]
    share = ["a"] * 60 + ["b"] * 30 + ["c"] * 6 + ["d"] * 3 + [None]
    df = frame(spark, texts, lambda i: share[i * 37 % 100]).withColumn("class", F.lit("clash")).withColumn("taken", F.lit(1))
    got = mixing.mix(df, keep=("class",)).toPandas()
    again = mixing.mix(df.repartition(7), keep=("class",)).toPandas()
    assert len(got) == len(texts) and got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    sizes = Counter()
    for i, t in enumerate(texts):
        sizes[share[i * 37 % 100]] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    for s, part in got.groupby(got.source.fillna("none")):
        source = None if s == "none" else s
        assert part.target.iloc[0] == pytest.approx(want[source]) and part.source_size.iloc[0] == sizes[source]
        largest = part["size"].max()
        assert abs(part.taken.sum() - want[source]) <= max(0.05 * want[source], 3 * largest)


def test_mixing_odd_tables(spark):
    empty = frame(spark, [])
    assert mixing.mix(empty).count() == 0
    none = mixing.mix(frame(spark, [None, "", None])).toPandas()
    assert len(none) == 3 and none.taken.eq(0).all() and none.target.eq(0).all()
    same = spark.createDataFrame([(1, "a b", "en", "s", 3)] * 5 + [(None, "a b", "en", "s", 3)], DOCS)
    got = mixing.mix(same).toPandas()
    assert len(got) == 6 and got.taken.sum() == pytest.approx(12, abs=2)
