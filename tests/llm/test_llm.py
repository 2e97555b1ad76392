"""The operators against brute force on small tables: nulls, empties, repeats, ties, clashing columns."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("strataq.llm")

from pyspark.sql import functions as F  # noqa: E402

from strataq.llm import attention_lm, common, jaccard_join, simple8b, toxicity  # noqa: E402
from strataq.llm.bpe import default_path, encoder  # noqa: E402
from strataq.llm.components import components  # noqa: E402
from strataq.llm.decontamination import decontaminate  # noqa: E402
from strataq.llm.jaccard_join import _exact, shingles, similar  # noqa: E402
from strataq.llm.licenses import _hits, scan  # noqa: E402
from strataq.llm.lm_scoring import score as lm_score  # noqa: E402
from strataq.llm.packing import difference, pack, windows  # noqa: E402
from strataq.llm.sharding import fisher_yates, shard  # noqa: E402
from strataq.llm.token_counts import MARK, count_tokens, default_path as pieces, counter  # noqa: E402
from strataq.llm.token_files import round_trip  # noqa: E402
from strataq.llm.top_k import top_k  # noqa: E402
from strataq.llm.toxicity import FUZZY, LIKE, STEM, WORD, Lexicon, score as toxicity_score  # noqa: E402

DDL = "doc_id long, text string, sequence_id string, shard string, row string, print string, key string"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
CASES = [(1, "Hello there, general reader."), (2, None), (3, ""), (3, "repeated row"), (3, "repeated row"), (None, "null id"), (4, LONG), (5, "日本語 ß é\n\n  two  spaces\t<|endoftext|>")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], DDL)


def bare(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_librarys():
    for _, text in CASES:
        assert np.frombuffer(encoder(default_path()).encode(text or ""), "<u4").tolist() == bare(text)


def test_encoder_keeps_letters_once():
    """Letters with marks behind them take no entry of their own; what is forgotten is learnt again."""
    from strataq.llm.bpe import _MARKS, BpeEncoder

    enc, r = BpeEncoder(default_path(), entries=60), random.Random(2)
    common = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 9))) for _ in range(20)]
    for turn in range(12):
        words = common + ["".join(r.choice("mnopq") for _ in range(7)) for _ in range(15)] + ["don't", "3-x", "-", "..."]
        texts = [" ".join(r.choice(words) + r.choice(["", ",", ".", "?!", ";"]) for _ in range(40)) + r.choice(["", " ", "  \n", "a\n, b"]) for _ in range(5)]
        for text, ids in zip(texts, enc.encode_many(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == bare(text)
        assert not any(c.rstrip(_MARKS).isalpha() and c[-1] in _MARKS for c in enc._chunks)
        assert len(enc._chunks) + len(enc._tails) <= 120
        assert turn < 2 or len(set(common) & set(enc._chunks)) > 15


def test_encoder_on_odd_strings():
    """White space of every kind, marks, special tokens: in batches, as the library has them one by one."""
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(default_path()), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "中", "\xa0", "1", ".", "'s", "<|endoftext|>", "\t", "_", "Th", "the", "\x1c", "\u3000"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for at in range(0, len(texts), 256):
        for text, ids in zip(texts[at : at + 256], encoder(default_path()).encode_many(texts[at : at + 256])):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert bare("a<|endoftext|>b") == [64, 50256, 65]


def test_difference_keeps_items():
    sizes = [8, 7, 6, 5, 4]
    out = difference(sizes, 2)
    assert sorted(i for w in out for i in w) == list(range(5))
    assert sorted(sum(sizes[i] for i in w) for w in out) == [14, 16]
    assert max(sum(sizes[i] for i in w) for w in windows([6, 6, 6], 10)) <= 10
    with pytest.raises(ValueError):
        windows([11], 10)


def test_pack(spark):
    got = pack(frame(spark, CASES), end_id=0).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    ids = np.array(bare(LONG) + [0], "<u4")
    mine = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.start)
    assert b"".join(r.ids for r in mine) == ids.tobytes()
    assert sum(r.length for r in got) == sum(len(bare(t)) + 1 for _, t in CASES)
    assert pack(frame(spark, CASES).limit(0)).count() == 0


def test_token_counts(spark):
    m, _ = counter(pieces())

    def best(word):  # all segmentations, by dynamic programming on every substring
        f = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            options = [(f[i][0] + m.score[word[i:j]], -f[i][1] - 1) for i in range(j) if word[i:j] in m.score]
            n = len(word[j - 1].encode())
            options.append((f[j - 1][0] + n * m.byte, -f[j - 1][1] - n))
            s, c = max(options)
            f.append((s, -c))
        return f[-1][1]

    words = ["hello", "hellos", "unbelievable", "ßé日", "x" * 50]
    assert m.counts([MARK + w for w in words]) == {MARK + w: best(MARK + w) for w in words}
    got = count_tokens(frame(spark, CASES)).collect()
    want = [(len((t or "").split()), sum(best(MARK + w) for w in (t or "").split())) for _, t in CASES if t is not LONG]
    assert sorted((r.n_pretokens, r.n_tokens) for r in got if r.doc_id != 4) == sorted(want)


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        for high in (1, 2, 50_257, 1 << 63):
            a = r.integers(0, high, n, dtype=np.uint64)
            a[::3] = 0
            assert (simple8b.decode(simple8b.encode(a)) == a).all()
    with pytest.raises(ValueError):
        simple8b.decode(simple8b.encode(a)[:-1] + b"\1")


def test_token_files(spark):
    got = round_trip(frame(spark, CASES), end_id=2).collect()
    assert Counter((r.doc_id, r.ids) for r in got) == Counter((i, np.array(bare(t) + [2], "<u4").tobytes()) for i, t in CASES)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id or 0 for r in sorted(got, key=lambda r: r.start)] == [0, 1, 2, 3, 3, 3, 4, 5]
    assert round_trip(frame(spark, CASES).limit(0)).count() == 0


WORD_RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontaminate(spark):
    items = [(1, "a b c d e f g h i j"), (2, "Hello THERE"), (3, None), (None, "x y"), (2, "hello there"), (4, "c d e f g h i j k")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = CASES + [(6, "z a B c-d e f g h i j k q"), (7, "a b c d e f g")]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wins = {}
    for i, t in items:
        w = WORD_RE.findall((t or "").translate(low))
        for k in range(max(0, len(w) - 7)) if len(w) >= 8 else range(bool(w)):
            if i is not None:
                wins.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    want = []
    for i, t in docs:
        w, hit, found = WORD_RE.findall((t or "").translate(low)), set(), set()
        for x, owners in wins.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= owners
        want.append((i or 0, len(w), len(hit), tuple(sorted(found))))
    for bound in (400_000, 0):
        got = decontaminate(frame(spark, docs), bench, broadcast_windows=bound).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == sorted(want)
    assert decontaminate(frame(spark, docs), bench.limit(0)).where("n_hit > 0").count() == 0


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.standard_normal(4)]) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)] + [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [1.0]), (20, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v in rows if v and len(v) == 4 and None not in v and not np.isnan(v).any()]
    want = Counter()
    for at, (q, x) in enumerate(good):
        if q % 20 == 0:
            best = sorted(((-int(x @ y), i) for j, (i, y) in enumerate(good) if j != at))[:10]
            want.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    got = top_k(df, F.col("vec_id") % 20 == 0, k=10, wave=3).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id < 200) == want
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def edits(word, term):
    """Distance with swaps of neighbours, by the whole table."""
    d = [[i + j if not i * j else 0 for j in range(len(term) + 1)] for i in range(len(word) + 1)]
    for i in range(1, len(word) + 1):
        for j in range(1, len(term) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (word[i - 1] != term[j - 1]))
            if i > 1 and j > 1 and word[i - 1] == term[j - 2] and word[i - 2] == term[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_lexicon():
    lex = Lexicon([("idiot", 4.0, WORD), ("scum", 4.0, WORD), ("achlich", 3.0, STEM)])
    assert lex.match("idiot")[0] == WORD and lex.match("scam") is None and lex.match("achlichheit")[0] == STEM and lex.match("idioooot") is None
    for word in ("idiiot", "idot", "idoit", "idiott"):
        assert lex.match(word)[0] == FUZZY
    for word in ("1diot", "adiot", "idiat", "ddiot", "diot", "xidiot"):
        assert lex.match(word)[0] == LIKE
    r = random.Random(5)
    terms = ["abcab", "abcde", "bcdea", "edcba", "aabba"]
    lex = Lexicon([(t, 1.0, WORD) for t in terms])
    for _ in range(4000):
        word = "".join(r.choice("abcde") for _ in range(r.randint(3, 7)))
        assert (lex.match(word) is not None) == (min(edits(word, t) for t in terms) <= 1), word


def test_toxicity(spark):
    """Terms are learnt from labels; misspelling, quotation, look-alikes and odd rows have their results."""
    r = random.Random(2)
    plain = "the of and with river stone window garden letter paper".split()
    text = lambda bad: " ".join(r.sample(plain, 6) + bad + r.sample(plain, 5))
    insults = ["grumbol", "zankort", "vilmex", "crashod"]
    docs = [(i, text(r.sample(insults, 2) if i % 2 else [])) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1, 0), (0, None)], "doc_id long, toxic int")
    odd = {1001: text(["grumbol", "zankort"]), 1002: text(["grmubol", "zankkort"]), 1003: text(["“grumbol", "zankort”"]), 1004: text(["crushod"]), 1005: "", 1006: None, 1007: "gr0mbol! " * 3, 1008: text([]) * 3000}
    docs += list(odd.items()) + [(1001, odd[1001]), (None, odd[1001])]
    got = toxicity_score(frame(spark, docs), labels).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    assert all(x.held_out == (x.doc_id is None or zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    by = {x.doc_id: x for x in got}
    assert [by[i].predicted for i in (1001, 1002, 1003, 1004, 1005, 1006, 1008, None)] == [1, 1, 0, 0, 0, 0, 0, 1]
    assert by[1005].score == by[1006].score and len({x.score for x in got if x.doc_id == 1001}) == 1
    assert sum(by[i].predicted != i % 2 for i in range(300)) == 0
    none = toxicity_score(frame(spark, docs), labels.limit(0)).collect()
    assert len({x.score for x in none}) == 1 and not any(x.predicted for x in none)
    assert toxicity_score(frame(spark, docs).limit(0), labels).count() == 0
    clashing = frame(spark, docs).withColumns({c: F.lit(1) for c in ("score", "held_out", "predicted", "carried", "_row")})
    kept = toxicity_score(clashing, labels, carry=True).where("predicted = 0").select("carried.*")
    assert kept.columns == clashing.columns and kept.count() == sum(x.predicted == 0 for x in got)


def test_toxicity_counts_terms_in_little_memory(monkeypatch):
    """A task gives back what its worker kept for another operator, and holds a bounded number of terms."""
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "TERMS", 300)
    monkeypatch.setattr(common, "_HELD", {("bpe",): object()})
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("abcdefg", k=7)) for _ in range(20)) for _ in range(200)] + [None, "", "abc abc"] * 2
    marks = [i % 3 == 0 for i in range(len(texts))]
    want = {False: Counter(), True: Counter()}
    for text, mark in zip(texts, marks):
        want[mark].update(toxicity._terms_of(text or ""))
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[s : s + 50], pa.string()), pa.array(list(map(int, marks[s : s + 50])))], names=["text", "toxic"]) for s in range(0, len(texts), 50)]
    got = list(toxicity._counts(iter(batches)))
    assert not common._HELD
    assert len(got) > 1 and max(b.num_rows for b in got) <= 300 + 20 * 6
    found = {False: Counter(), True: Counter()}
    for x in (x for b in got for x in b.to_pylist()):
        found[False][x["term"], x["kind"]] += x["clean"]
        found[True][x["term"], x["kind"]] += x["toxic"]
    assert {k: +c for k, c in found.items()} == want


def test_shards(spark):
    assert sorted(fisher_yates(100, np.random.default_rng(1)).tolist()) == list(range(100))
    rows = CASES + [(7, "same")] * 50
    got = shard(frame(spark, rows), n_shards=4, bucket_bytes=200).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert shard(frame(spark, rows).limit(0)).count() == 0


def test_attention_gradients_and_windows():
    r = np.random.default_rng(0)
    n = attention_lm.SYMBOLS
    pairs = r.standard_normal((n, n))
    w = {k: v.astype(np.float64) for k, v in attention_lm.start(1).items()}
    x = r.integers(0, n, (2, attention_lm.WINDOW))
    t = r.standard_normal((2, attention_lm.WINDOW, n))
    kept = []
    attention_lm.forward(w, x, pairs, 0, kept)
    g = attention_lm.backward(w, x, t, kept)
    for k, at in (("q", (1, 2)), ("v", (0, 3)), ("a", (2, 2)), ("p", (1,))):
        lo, hi = w[k][at] - 1e-5, w[k][at] + 1e-5
        w[k][at] = hi
        up = (attention_lm.forward(w, x, pairs) * t).sum()
        w[k][at] = lo
        down = (attention_lm.forward(w, x, pairs) * t).sum()
        w[k][at] = lo + 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))
    logits = attention_lm.pair_logits(r.integers(0, 5, (n, n)))
    assert np.allclose(np.exp(logits).sum(1), 1, atol=1e-4)
    f = attention_lm.prepared(attention_lm.start(1), logits, 100)
    s = r.integers(0, n, 100).astype(np.uint8)
    other = np.concatenate([s[:60], r.integers(0, n, 40).astype(np.uint8)])
    (a, z), (b, _) = attention_lm.log10_probabilities(f, [s, other])
    assert len(a) == 99 and np.allclose(a[:59], b[:59]) and (a < 0).all() and (z < 0).all()  # causal
    # the first window against the plain forward pass
    full = attention_lm.forward(attention_lm.start(1), np.concatenate([np.full(8, s[0]), s[:24]])[None].astype(int), logits)[0, 8:]
    full -= np.log(np.exp(full).sum(1, keepdims=True))
    assert np.allclose(full[np.arange(24), s[1:25]] / np.log(10), a[:24], atol=1e-4)
    opens = np.log10(np.exp(full[:, :100]).sum(1) + np.exp(full[:, -1]))
    assert np.allclose(opens, z[:24], atol=1e-4)


def test_attention_works_on_few_logits_at_once():
    """The softmax of a step and of scoring goes by blocks: gradients as in one piece, and no array of all logits."""
    import tracemalloc

    r, n = np.random.default_rng(3), attention_lm.SYMBOLS
    pairs = r.standard_normal((n, n)).astype(np.float32)
    for scale in (1, 40):  # the second is beyond the exponents of float32
        w = {k: v * np.float32(scale if k == "u" else 1) for k, v in attention_lm.start(1).items()}
        x = r.integers(0, n, (2 * attention_lm.PLACES // attention_lm.WINDOW + 1, attention_lm.WINDOW))
        y, kept = r.integers(0, n, x.size), []
        p = attention_lm.forward(w, x, pairs, 0, kept).reshape(-1, n).astype(np.float64)
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(x.size), y] -= 1
        want = attention_lm.backward(w, x, (p / x.size).astype(np.float32), kept)
        z = kept[-1].reshape(-1, attention_lm.WIDTH)
        got, dz = attention_lm.softmax_gradients(w, z, x.ravel(), y, pairs, np.empty((2, attention_lm.PLACES, n), np.float32))
        got |= attention_lm.behind(w, x, dz, kept)
        for k in w:
            assert np.allclose(got[k], want[k], atol=1e-5 * max(1, np.abs(want[k]).max())), k
    stream = r.integers(0, n, 20_000).astype(np.uint8)
    model = attention_lm.prepared(attention_lm.start(1), pairs, 100)
    for work, most in ((lambda: attention_lm.train(attention_lm.fresh(0), stream, pairs), 4_500_000), (lambda: attention_lm.log10_probabilities(model, [stream]), 2_200_000)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


def test_lm_scoring(spark):
    """Counts and base by brute force, over nulls, empties, repeats, a null id and a long text in pieces."""
    docs = [(i, f"the cat sat on the mat {'and the dog ran' if i % 2 else 'the END'} w{i}") for i in range(40)] + [(50, None), (51, ""), (52, LONG), (53, "x" * 3000), (7, "again"), (7, "again")]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c, ends = Counter(), 0
    for i, t in docs:
        if not held[i]:
            c.update((t or "").lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    got = lm_score(frame(spark, docs + [(None, "the cat")])).collect()
    assert len(got) == len(docs) + 1 and all(r.held_out for r in got if r.doc_id is None)
    left = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got if r.doc_id is not None)
    want = Counter()
    for i, t in docs:
        words = (t or "").lower().split()
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words) + np.log10((ends + 1) / (n + v + 1))
        want[(i, held[i], len(words) + 1, sum(c[w] > 0 for w in words) + 1, n, round(float(base), 5))] += 1
    assert left == want and all(r.attention_score < 0 and r.score < 0 and np.isfinite(r.score) for r in got)
    assert lm_score(frame(spark, docs).limit(0)).count() == 0


def test_words_in_pieces_count_alike(spark, monkeypatch):
    from strataq.llm import lm_scoring

    docs = [(i, f"the cat sat on the mat w{i} " * 9) for i in range(20)]
    whole = {r.doc_id: r for r in lm_score(frame(spark, docs)).collect()}
    monkeypatch.setattr(lm_scoring, "PIECE_WORDS", 10)
    monkeypatch.setattr(lm_scoring, "CHUNK_WORDS", 12)
    for r in lm_score(frame(spark, docs)).collect():
        w = whole[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (w.n_tokens, w.n_known, w.train_tokens) and abs(r.base_score - w.base_score) < 1e-6


def test_attention_earns_its_score(spark):
    """Held-out texts: the model with attention is better than the shares of ids in its place, and knows text from junk."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    junk = spark.createDataFrame([(i, "qz xj wv " * 20) for i in range(5000, 5100)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(junk.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2"))
    sums = [{r.junk: r for r in lm_score(docs, attention=a).where("held_out").groupBy((F.col("doc_id") >= 5000).alias("junk")).agg(F.sum("score").alias("s"), F.sum("attention_score").alias("a"), F.sum("n_tokens").alias("n")).collect()} for a in (True, False)]
    (on, off) = sums
    assert on[False].s > 0.95 * off[False].s and on[False].a > 0.9 * off[False].a
    assert on[True].s / on[True].n < on[False].s / on[False].n  # junk is less likely, word by word


def test_unseen_words_are_spelled(spark):
    text = "the cat sat on the mat and the dog ran"
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    docs = [(i, text) for i in range(60) if i not in held]
    short, long = (next(r for r in lm_score(frame(spark, [*docs, (held[0], "qj"), (held[1], "qj" * 30)])).collect() if r.doc_id == h) for h in held)
    assert short.n_known == long.n_known == 1 and short.score > long.score + 5


def test_attention_training_covers_the_corpus(spark, monkeypatch):
    """Pairs count every training document; strips hold the asked share of each, in proportion."""
    from strataq.llm import lm_scoring
    from strataq.llm.attention_lm import SYMBOLS, Symbols

    rows = [(i, lm_scoring._narrow(np.full(4000, 5 + i)), True, 2000, 4000) for i in range(40)]
    train = spark.createDataFrame(rows, "row long, ids binary, last boolean, n long, m long")
    counts = np.zeros(300)
    counts[5:45] = 4000
    names = [bytes([i % 256, i // 256]) for i in range(300)]
    symbols = Symbols(counts, np.arange(300) % 2 == 0, names, 299)
    pairs = lm_scoring._pairs(train, symbols)
    assert pairs.shape == (SYMBOLS, SYMBOLS) and pairs.sum() == 40 * 4001
    got = lm_scoring._strips(train, symbols, 1.0, 0).collect()
    assert sum(len(r.data) - 1 for r in got) == 40 * 4001
    part = lm_scoring._strips(train, symbols, 0.5, 0).collect()
    assert 40 < len(part) < 120 and {bytes(r.data) for r in part} <= {bytes(r.data) for r in got}
    # many states are averaged by layers of tasks
    monkeypatch.setattr(lm_scoring, "FAN", 2)
    monkeypatch.setattr(lm_scoring, "PART", 20_000)
    monkeypatch.setattr(lm_scoring, "LEAST", 1)
    monkeypatch.setattr(lm_scoring, "SHARE", 1.0)
    w = lm_scoring._fit(train, symbols, attention_lm.pair_logits(pairs), float(counts.sum()), 0)
    assert all(np.isfinite(v).all() for v in w.values())


def test_attention_learns_from_every_symbol(spark, monkeypatch):
    """The rounds' strips are all symbols of the training documents, each once, also where the corpus is a large one."""
    from strataq.llm import lm_scoring
    from strataq.llm.attention_lm import Symbols, pair_logits

    rows = [(i, lm_scoring._narrow(np.full(4000, 5 + i)), True, 2000, 4000) for i in range(40)]
    train = spark.createDataFrame(rows, "row long, ids binary, last boolean, n long, m long")
    counts = np.zeros(300)
    counts[5:45] = 4000
    symbols = Symbols(counts, np.arange(300) % 2 == 0, [bytes([i % 256, i // 256]) for i in range(300)], 299)
    seen, whole = Counter(), lm_scoring._round

    def round_(rows, *rest):
        strips = [bytes(r.data) for r in rows.collect()]
        seen.update(x for s in strips for x in s[1:])
        return whole(rows, *rest)

    monkeypatch.setattr(lm_scoring, "_round", round_)
    monkeypatch.setattr(lm_scoring, "LEAST", 1)  # as for a corpus of any size
    monkeypatch.setattr(lm_scoring, "PART", 20_000)
    lm_scoring._fit(train, symbols, pair_logits(lm_scoring._pairs(train, symbols)), float(counts.sum()), 0)
    want = Counter()
    for i in range(5, 45):
        want[int(symbols.of[i])] += 4000
    want[attention_lm.END] += 40
    assert seen == want


def test_words_travel_by_chunks(spark, monkeypatch):
    """A chunk's words come back in few rows, with ids, counts and positions as by brute force."""
    from strataq.llm import lm_scoring

    texts = [f"the cat{i % 7} sat on w{i} ü{i} {'x' * (i % 300)}" for i in range(400)]
    docs = spark.createDataFrame([(i, i % 3 == 0, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").repartition(3)
    chunks = lm_scoring._chunks(docs).localCheckpoint()
    words = {(r.chunk, r.pos): bytes(r.data) for r in chunks.where(F.col("pos") < lm_scoring._DOCS).collect()}
    total = Counter(w for i, t in enumerate(texts) if i % 3 for w in lm_scoring.words_of(t))
    s = lm_scoring.subwords(lm_scoring.default_path())
    for most in (500_000, 50):
        monkeypatch.setattr(lm_scoring, "GATHER_WORDS", most)
        rows, firsts = lm_scoring._counted(chunks, lm_scoring.default_path()).collect(), Counter()
        assert len(rows) < len(words) / (10 if most > 50 else 2)
        for chunk in {c for c, _ in words}:
            n, sizes, at, flat = lm_scoring._scattered([(r.n, bytes(r.data)) for r in rows if r.chunk == chunk])
            assert len(n) == sum(c == chunk for c, _ in words)
            for pos, (c, k, a) in enumerate(zip(n.tolist(), sizes.tolist(), at.tolist())):
                w = words[chunk, pos]
                assert c >> 1 == total[w] and flat[a : a + k].tobytes() == s.ids(w)
                firsts[w] += c & 1
        assert set(firsts.values()) == {1} and set(firsts) == set(words.values())


def test_attention_goes_by_words(spark, monkeypatch):
    """Attention learns from one place a word and one a text, however many ids the words take; documents are put together again over chunks."""
    from strataq.llm import lm_scoring

    texts = [f" The cat{i % 7} saton\tw{i} ü{i}\n{'xq' * (i % 30)} " * (i % 5) for i in range(60)] + [None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(lm_scoring, "CHUNK_WORDS", 12)
    monkeypatch.setattr(lm_scoring, "PIECE_WORDS", 5)
    seen, whole = [], lm_scoring._fit

    def fit(train, symbols, pairs, size, seed):
        seen.append((size, pairs.shape, sum(len(r.data) - 1 for r in lm_scoring._strips(train, symbols, 1.0, seed).collect()), train.where("last").count()))
        return whole(train, symbols, pairs, size, seed)

    monkeypatch.setattr(lm_scoring, "_fit", fit)
    monkeypatch.setattr(lm_scoring, "LEAST", 1)
    got = {r.doc_id: r for r in lm_score(docs).collect()}
    assert len(got) == len(texts) and all(r.n_tokens == len(lm_scoring.words_of(texts[i] or "")) + 1 for i, r in got.items())
    places = sum(r.n_tokens for r in got.values() if not r.held_out)
    ((size, _, strips, ends),) = seen
    assert size == strips == places == got[0].train_tokens and ends == sum(not r.held_out for r in got.values())

    chunks = lm_scoring._chunks(docs.selectExpr("doc_id", "doc_id % 3 = 0 AS held_out", "text")).collect()
    words, pieces = {(r.chunk, r.pos): r for r in chunks if r.pos < lm_scoring._DOCS}, {}
    for r in sorted((r for r in chunks if r.pos >= lm_scoring._DOCS), key=lambda r: (r.chunk, r.pos)):
        _, doc, null, held, last = struct.unpack_from(lm_scoring._HEAD, r.data)
        assert not null and held == (doc % 3 == 0) and r.n <= 5
        numbers = lm_scoring._wide(bytes(r.data[lm_scoring._HEAD_SIZE :]), r.n).tolist()
        pieces.setdefault(doc, []).append((last, [bytes(words[r.chunk, i].data) for i in numbers]))
    assert len({r.chunk for r in chunks}) > 4
    for i, text in enumerate(texts):
        assert [w for _, some in pieces[i] for w in some] == lm_scoring.words_of(text or "") and [x for x, _ in pieces[i]] == [False] * (len(pieces[i]) - 1) + [True]
    learnt = Counter()
    for r in words.values():
        learnt[bytes(r.data)] += r.n
    assert +learnt == Counter(w for i, t in enumerate(texts) if i % 3 for w in lm_scoring.words_of(t or ""))


def test_spellings_by_brute_force():
    """Every id behind a word's first, and its end, has the row of the two symbols before; rows are probabilities."""
    from strataq.llm.lm_scoring import _spelt

    r, n, end = np.random.default_rng(5), attention_lm.SYMBOLS, attention_lm.END
    lens = r.integers(1, 5, 200)
    opener, tails = r.integers(0, n, 200).astype(np.uint8), r.integers(0, n - 1, int(lens.sum()) - 200).astype(np.uint8)
    at, place = _spelt(opener, tails, lens)
    want, left = [], tails.tolist()
    for o, k in zip(opener.tolist(), lens.tolist()):
        some, left = left[: k - 1], left[k - 1 :]
        for j, y in enumerate([*some, end]):
            row = o if j == 0 else n + o * n + some[0] if j == 1 else n + n * n + some[j - 2] * n + some[j - 1]
            want.append(row * n + y)
    assert place.tolist() == want and at.tolist() == (np.cumsum(lens) - lens).tolist()
    assert [len(x) for x in _spelt(opener[:0], tails[:0], lens[:0])] == [0, 0]
    table = attention_lm.spelling_logits(np.bincount(place, minlength=(n + 2 * n * n) * n).reshape(-1, n))
    rows = np.unique(place // n)
    assert np.allclose((10.0 ** table[rows]).sum(1), 1, atol=1e-4) and table.take(place).mean() > table[rows].mean()


def test_licenses(spark):
    docs = CASES + [(8, "some text\nReleased under the MIT License.\nmore"), (9, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."), (10, "a driver license is a general public matter")]
    got = {r.doc_id: r for r in scan(frame(spark, docs)).collect()}
    assert got[8].license == "mit" and got[9].families == "apache-2.0,proprietary" and got[10].license == "unknown" and got[2].n_notices == 0
    assert scan(frame(spark, docs)).count() == len(docs)


MIT = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files"


def test_licenses_wrapped(spark):
    nc = "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License."
    narrow = "\n".join("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met".split())
    docs = [(20, MIT), (21, f"a letter\n\n# {MIT}\n\nmore"), (22, nc), (23, narrow), (24, MIT.replace("any\n", "any\n\n")), (25, f"{MIT}\nAll rights reserved.\n{nc}")]
    got = {r.doc_id: r for r in scan(frame(spark, docs)).collect()}
    assert [got[i].families for i in range(20, 26)] == ["mit", "mit", "cc-by-nc", "bsd", "", "cc-by-nc,mit,proprietary"]
    assert [got[i].n_notices for i in (20, 21, 22, 23, 25)] == [1, 1, 1, 1, 3] and got[22].coverage == 1


def test_licenses_gate(spark):
    docs = [(20, "CC BY-SA 4.0"), (21, "CC BY-NC 4.0"), (22, "This text is available under CC BY-SA 4.0."), (23, "text under\nCC BY-ND\n4.0 here"), (24, "by 4 of the 0 under"), (25, MIT), (26, "a_mit_license, GPL-3.0-or-later")]
    rows = {gated: {r.doc_id: r for r in scan(frame(spark, CASES[:3] + docs), gated=gated).collect()} for gated in (True, False)}
    assert rows[True] == rows[False]
    assert [rows[True][i].license for i in (20, 21, 22, 23, 25)] == ["cc-by-sa", "cc-by-nc", "cc-by-sa", "cc-by-nd", "mit"]


def test_licenses_carry_only_lines_in_reach(spark):
    long, short = " ".join(["word"] * 30 + ["license"]), "free to use"
    docs = [(1, "\n".join([long] * 40)), (2, "\n".join([short] * 40)), (3, f"{short}\n\n{short}\n{short}")]
    rows = _hits(frame(spark, docs), "doc_id", "text", ("license", "use"), 25).collect()
    assert all(len(r.by) <= 3 for r in rows if r.doc_id == 1) and len(rows) == 83
    # eight lines of three words may lie between, so a window of line 21 begins at line 12 or ends at line 30
    assert [(r.lo, len(r.by)) for r in rows if r.doc_id == 2 and r.i == 21] == [(12, 19)]
    assert all(r.by[r.here - 1].n == 3 for r in rows if r.doc_id != 1)


def test_licenses_weigh_only_grams_with_a_weight(spark):
    """Grams are chosen before they are exploded, and their sums are hashed without a sort."""
    from strataq.llm.licenses import TEMPLATES, _grams, _weighted, train

    weights, r = train()[1], random.Random(3)
    pool = [*{w for t in TEMPLATES.values() for x in t for w in re.findall("[a-z0-9]+", x.lower())}, "other", "words"]
    texts = [" ".join(r.choice(pool) for _ in range(n)) for n in (0, 1, 2, 3, 40, 200)] + [x for t in TEMPLATES.values() for x in t]
    words = [(i, re.findall("[a-z0-9]+", x.lower())) for i, x in enumerate(texts)] + [(len(texts), None)]
    got = dict(spark.createDataFrame(words, "i long, words array<string>").select("i", _weighted("words", tuple(weights))).collect())
    assert all(len(set(got[i])) == len(got[i]) and set(got[i]) == _grams(x) & set(weights) for i, x in enumerate(texts)) and not got[len(texts)]
    assert "SortAggregate" not in scan(frame(spark, CASES))._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(5, 5)], "u long, v long")
    got = {r.node: r.root for r in components(e).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(100, 130)} == {100}


def test_components_converge_or_raise(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        components(e, most_rounds=1)


def test_similar(spark):
    base = [f"t{i}" for i in range(60)]
    near = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in (0, 1, 58, 59, 30)]
    docs = CASES + [(20 + i, t) for i, t in enumerate([" ".join(base), *near, " ".join(base).upper()])] + [(40, None), (41, "two words"), (42, "Two, words!")]
    rows = [(i, t or "") for i, t in docs]
    sets = [set(shingles(t).tolist()) for _, t in rows]
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j:
                a, b = sets[i], sets[j]
                links[i] += len(a & b) >= 0.8 * len(a | b) if a and b else not a and not b and rows[i][1] == rows[j][1]
    got = similar(frame(spark, docs)).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in got) == sorted((i or 0, n) for (i, _), n in zip(rows, links))
    # one row a class stays; id 3 is in two classes, which the empty set tells apart
    assert sum(r.kept for r in got) == len({(r.class_id, r.n_shingles == 0) for r in got})
    assert similar(frame(spark, docs).limit(0)).count() == 0


def test_near_duplicates_give_memory_back_behind_each_task(spark, monkeypatch):
    """Each Python step of the join drops what other operators keep, and returns its memory at its end."""
    done = []
    monkeypatch.setattr(common, "_HELD", {("bpe",): object()})
    monkeypatch.setattr(common, "release", lambda: done.append(len(common._HELD)))

    def work(batches):
        assert not common._HELD
        done.append("work")
        yield from batches

    assert list(common.tidy(work)(iter([1, 2]))) == [1, 2] and done == [0, "work", 0]
    wrapped = []
    monkeypatch.setattr(jaccard_join, "tidy", lambda f: wrapped.append(f.__qualname__.split(".")[0]) or f)
    similar(frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g h")]), n=2, threshold=0.5).collect()
    assert set(wrapped) == {"similar", "_compare", "_verified"}


@pytest.mark.parametrize("sides", [1, 2])
def test_verified_blocks_are_judged_in_little_memory(sides):
    import tracemalloc

    rng = np.random.default_rng(sides)
    m = 1500
    kinds = [rng.integers(0, 1 << 62, 12, dtype=np.uint64) for _ in range(60)]
    sets = [np.unique(np.append(kinds[i % 60][: 12 - i % 3], rng.integers(0, 1 << 62, i % 2, dtype=np.uint64))) for i in range(m)]
    side, copies = np.arange(m) % sides, np.arange(m) % 5 + 1
    tracemalloc.start()
    links, u, v = _exact(np.arange(m), copies, side, sets, 800, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * m * m  # pairs' counts as whole numbers of eight bytes took 37 a pair
    alike = lambda i, j: (sides == 1 or side[i] != side[j]) and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
    near = {i: [j for j in range(i % 60, m, 60) if j != i and alike(i, j)] for i in range(0, m, 7)}
    assert {i: sum(int(copies[j]) for j in near[i]) for i in near} == {i: int(links[i]) for i in near}
    assert all(alike(int(i), int(j)) for i, j in zip(u, v))


def test_pipeline_keeps_documents_with_one_short_item(spark, tmp_path):
    import corpus_pipeline

    long = "one two three four five six seven eight nine"
    spark.createDataFrame([(1, "the"), (2, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [(20, "the cat and the dog " * 9), (21, f"so {long} and more"), (22, "nothing here")])
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {20, 22}


def test_pipeline(spark):
    import corpus_pipeline
    from strataq.llm.common import written

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = written(f(spark, stage, sf), "test")
        assert stage.columns == docs.columns
    assert kept == {r.doc_id for r in stage.collect()} and 0 < len(kept) < docs.count()


def test_pipeline_on_odd_tables(spark):
    """Clashing names, nulls, repeats and no rows, through every stage, against plain rules."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    names = ("score", "held_out", "predicted", "carried", "_row", "row", "class_id", "kept", "words", "sequence_id")
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in CASES + [(90, item), (91, "copy " * 30), (92, "copy " * 30)]], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    want = [
        Counter(r[:2] for r in docs.collect()),
        # null, empty and equal texts: the least id stays
        Counter([(1, CASES[0][1]), (2, None), (3, "repeated row"), (None, "null id"), (4, LONG), CASES[-1], (90, item), (91, "copy " * 30)]),
        Counter([(1, CASES[0][1]), (2, None), (3, "repeated row"), (None, "null id"), (4, LONG), CASES[-1], (91, "copy " * 30)]),
    ]
    for at, (_, f) in enumerate(corpus_pipeline.STAGES):
        assert f(spark, docs.limit(0), sf).count() == 0
        now = f(spark, docs, sf)
        if at < 3:
            assert now.columns == docs.columns
            rows = now.collect()
            assert all(set(r[2:]) == {"x"} for r in rows) and Counter(r[:2] for r in rows) == want[at]
            docs = spark.createDataFrame(rows, docs.schema)
        else:
            assert {r.doc_id for r in now.collect()} == {d for d, _ in want[2]}


@pytest.mark.parametrize("name", ["op4_decontamination", "op5_top_k"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from strataq.llm.queries import ORACLE_SQL, QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, sf).collect()]
    assert Counter(got) == Counter(want.fetchall()) and got
