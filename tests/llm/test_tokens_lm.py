import hashlib
import math
import random
import re
from array import array
from collections import Counter

import pytest

from kbspark.llm import backoff_lm
from kbspark.llm.backoff_lm import score_documents
from kbspark.llm.bins import CAPACITIES, pack, pack_documents, packed_pieces
from kbspark.llm.piece_bpe import PieceBpe, encode_digests, encode_documents

DOC = "doc_id long, text string, lang string, n_tokens string"

sp = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    return PieceBpe(MODEL), sp.SentencePieceProcessor(model_file=MODEL)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "xx", "clash") for i, t in enumerate(texts)], DOC)


HARD = ["", " ", "   ", "a", "\n", "\n\n a", "▁", "▁▁x", "a ▁ b", "<s> </s> <unk> <0x41>", "0123 45", "é́", "日本語 テスト", "𝄞🙂‍🙂",
        "\x00\x01", "x" * 300, " " * 300 + "y", "tabs\tand\r\nlines", "ation" * 50, "İSTANBUL ſ ß"]


def test_encode_and_decode_equal_the_library(bpe):
    own, lib = bpe
    r = random.Random(7)
    parts = ["th", "in", "er", "▁", " ", "  ", "ation", "the", "\n", "é", "日", "!", "un", "re", "7", "s"]
    texts = HARD + ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(1500)]
    for t in texts:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == ids, t
        assert own.decode(ids) == lib.decode(ids), t


def test_decode_of_any_ids_equals_the_library(bpe):
    own, lib = bpe
    r = random.Random(3)
    for _ in range(3000):
        ids = [r.choice([1, 2, r.randint(3, 258), r.randint(259, 31999), 29871]) for _ in range(r.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_memo_tables_do_not_change_results(bpe, monkeypatch):
    import kbspark.llm.piece_bpe as m
    monkeypatch.setattr(m, "MAX_SEGMENTS", 3)
    monkeypatch.setattr(m, "MAX_PAIRS", 3)
    own = PieceBpe(MODEL)
    for t in HARD:
        assert own.encode(t) == bpe[1].encode(t, add_bos=True, add_eos=True)


def test_digests(spark, bpe):
    texts = HARD + [None, "word " * 30000]
    got = {r.doc_id: r for r in encode_digests(docs(spark, texts), MODEL).collect()}
    for i, t in enumerate(texts):
        ids = bpe[1].encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(bpe[1].decode(ids).encode()).hexdigest()
    assert encode_digests(docs(spark, texts).limit(0), MODEL).count() == 0
    row = encode_documents(docs(spark, ["a b", None]), MODEL).orderBy("doc_id").collect()
    assert row[0].decoded == "a b" and row[1].ids == [1, 2]


def brute_lm(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    count = Counter(w for ws in words for w in ws)
    every = sum(count.values()) + len(count)
    n_docs = sum(bool(ws) for ws in words)
    pairs = [Counter(zip(["<s>", *ws], ws)) for ws in words]
    total = Counter()
    for p in pairs:
        total.update(p)
    out = []
    for i, (ws, p) in enumerate(zip(words, pairs)):
        e6 = back = 0
        for v, w in zip(["<s>", *ws], ws):
            others = total[v, w] - p[v, w]
            if others > 0:
                e6 += round(1e6 * math.log10(others / (n_docs if v == "<s>" else count[v])))
            else:
                e6 += round(1e6 * math.log10(0.4 * (count[w] + 1) / every))
                back += 1
        out.append((i, len(ws), back, e6))
    return out


def lm_rows(df):
    return sorted((g.doc_id, g.n_words, g.n_backoff, g.logprob_e6) for g in df.collect())


@pytest.mark.parametrize("hot_rows,bound", [(200_000, 1_000_000), (20, 1_000_000), (1, 0)])
def test_lm_scores_against_brute_force(spark, monkeypatch, hot_rows, bound):
    monkeypatch.setattr(backoff_lm, "BROADCAST_WORDS", bound)
    monkeypatch.setattr(backoff_lm, "FILTER_KEYS", bound)
    r = random.Random(hot_rows)
    words = ["the", "cat", "Sat", "on", "mat", "é", "ÉÉ", "x1", "rare"] + [f"w{i}" for i in range(20)]
    texts = [" ".join(r.choice(words[:r.choice([5, 29])]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    texts += [None, "", " \n", "the cat", "the cat", "the " * 3000, "only here", "never again " * 500]
    df = score_documents(docs(spark, texts), hot_rows=hot_rows)
    assert lm_rows(df) == brute_lm(texts)
    assert all((g.mean_logprob is None) == (g.n_words == 0) for g in df.collect())


def test_lm_counts_words_beyond_any_vocabulary(spark):
    # 70,000 words, each in two documents: bigrams of words of equal counts are found, none is unknown
    texts = [" ".join(f"u{k}" for k in range(i, i + 700)) for i in range(0, 70_000, 700)] * 2
    got = lm_rows(score_documents(docs(spark, texts), hot_rows=1000))
    assert got == brute_lm(texts) and all(g[2] == 0 for g in got)


def test_lm_repeats_null_ids_and_empty(spark):
    texts = ["of the of the"] * 400 + ["the of"]
    df = docs(spark, texts)
    assert lm_rows(score_documents(df)) == lm_rows(score_documents(df, hot_rows=1)) == brute_lm(texts)
    null = spark.createDataFrame([(None, "a b", "", ""), (None, "a b", "", "")], DOC)
    assert [g.doc_id for g in score_documents(null).collect()] == [None, None]
    assert score_documents(df.limit(0)).count() == 0


def test_lm_parts_share_out_the_ngrams_and_change_no_score(spark):
    r = random.Random(6)
    texts = [" ".join(f"w{int(r.paretovariate(0.6)) % 2000}" for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += texts[:50] + [None, "", "the cat", "the cat", "only here"]
    df = docs(spark, texts)
    whole = sorted(map(tuple, backoff_lm._count_table(df).collect()), key=str)
    for parts in (2, 3):
        counts = [backoff_lm._count_table(df, i, parts).collect() for i in range(parts)]
        assert sorted((tuple(g) for c in counts for g in c), key=str) == whole          # each n-gram in one part
        assert max(map(len, counts)) < len(whole) * 1.3 / parts                         # none is much larger
    want = brute_lm(texts)
    advisory, size = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        for parts, now in ((1, size), (2, "8m"), (3, size)):                            # 8m: AQE joins by hash
            spark.conf.set(advisory, now)
            assert lm_rows(score_documents(df.repartition(3), hot_rows=50, parts=parts)) == want    # hot n-grams in any part, others joined
    finally:
        spark.conf.set(advisory, size)


def test_lm_parts_meet_by_id_and_text(spark):
    # equal rows, null ids, one id with several texts and one text with several ids: the rows of the parts must not mix
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "d c b a e"), (None, "a b c d"), (None, "a b c d"), (2, "a b c d"), (None, None), (None, ""), (1, None), (3, "z")]
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOC)
    want = sorted(((i, *g[1:]) for (i, _), g in zip(rows, brute_lm([t for _, t in rows]))), key=str)
    for parts in (1, 2, 5):
        got = score_documents(df, parts=parts).collect()
        assert sorted(((g.doc_id, g.n_words, g.n_backoff, g.logprob_e6) for g in got), key=str) == want


def test_pack_holds_everything_and_downsizes():
    r = random.Random(2)
    for _ in range(30):
        lengths = [r.choice([1, 7, 60, 200, 511, 512, 900, 2048]) for _ in range(r.randint(0, 200))]
        bins = pack(lengths, (512, 1024, 2048))
        assert sorted(i for _, m in bins for i in m) == list(range(len(lengths)))
        for c, m in bins:
            used = sum(lengths[i] for i in m)
            assert used <= c and c == min(x for x in (512, 1024, 2048) if x >= used)
    assert pack([], (512,)) == []
    # the least-cost bin: many small pieces are worth the largest size, one lone piece is not
    assert pack([100] * 20, (512, 2048), overhead=16) == [(2048, list(range(20)))]
    assert pack([100], (512, 2048)) == [(512, [0])]


def test_packed_documents(spark):
    texts = [None, "", "a b c", "x " * 20000, "tab\tand\x1cunit sep"] + ["w " * n for n in range(1, 400, 7)]
    df = docs(spark, texts).unionByName(docs(spark, texts[:3]))
    bins_ = pack_documents(df).collect()
    assert all(sum(b.lengths) + len(b.lengths) == b.n_tokens <= b.capacity and b.capacity in CAPACITIES for b in bins_)
    assert len({b.bin_id for b in bins_}) == len(bins_)
    assert sum(b.n_tokens for b in bins_) / sum(b.capacity for b in bins_) > 0.8
    pieces = packed_pieces(df).collect()
    whole = Counter()
    for p in pieces:
        whole[p.doc_id] += p.n_words
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert all(whole[i] == n * (2 if i < 3 else 1) for i, n in enumerate(words))
    long = sorted((p.piece, p.start_word, p.n_words) for p in pieces if p.doc_id == 3)
    assert long == [(0, 0, 8191), (1, 8191, 8191), (2, 16382, 3618)]
    joined = " ".join(b.text for b in bins_)
    assert joined.count("x") == 20000 and len(re.findall(r"\bw\b", joined)) == sum(range(1, 400, 7))
    by_bin = {}
    for p in sorted(pieces, key=lambda p: (p.bin_id, p.bin_offset)):
        assert p.bin_offset == by_bin.get(p.bin_id, 0)
        by_bin[p.bin_id] = p.bin_offset + p.n_words + 1
    assert pack_documents(df.limit(0)).count() == 0 and packed_pieces(df.limit(0)).count() == 0
