"""The llm operators against plain versions, round trips and awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from sparkloom.llm import bpe, components, jaccard, kdtree, language, licenses, media, mixing, queries, secrets, substrings, token_counts  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [None, "", " ", "\n\t", "é", "a", "two words", "\u0000x", "中文字" * 30, "😀 " * 40, "x" * 3000, "word " * 3000]


def docs(spark, texts, start=0, **columns):
    rows = [(start + i, t, "en" if i % 2 else None, f"s{i % 3}", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, v in columns.items():
        df = df.withColumn(k, v)
    return df


def awkward(spark):
    """Awkward texts, each row twice, with columns whose names operators use themselves."""
    df = docs(spark, AWKWARD)
    return df.union(df).withColumns({"id": F.lit("x"), "key": F.lit(1), "copy_no": F.lit(9), "score": F.lit(2), "hash": F.lit(3), "n_tokens": F.lit(4)} | {c: F.lit(5) for c in "row base bare copied live done of mean cdf parts u times first node n hi lo hashes words at near p d q v s tile cell feature spans lang_pred".split()})


def test_bpe_agrees_with_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    encoder = bpe.text_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.v.ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = ["a", "the", "ing", " ", "  ", "\n", "é", "中", "😀", "'s", "12", "-", " ", "\x1c", "<|endoftext|>"]
    for _ in range(400):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        ids = encoder.encode(s)
        assert ids == library.encode_ordinary(s)
        assert encoder.decode(ids) == s.encode()


def test_prefix_encoder_appends_and_edits():
    v = bpe.text_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).v
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdeinghto") for _ in range(400))
    grown = bpe.PrefixEncoder(v)
    for i in range(0, 400, 7):
        grown.append(text[i : i + 7])
    assert grown.tokens() == v.merged(text) and grown.last == bpe.last_tokens(v, text)
    done = grown.replace(100, 104, b"qq")
    assert grown.tokens() == v.merged(text[:100] + b"qq" + text[104:]) and done < 200


def test_bpe_documents(spark):
    args = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.encode_documents(awkward(spark), *args).collect()
    assert len(rows) == 2 * len(AWKWARD)
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256((AWKWARD[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, []), *args).count() == 0


def brute_components(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_texts(seed, groups=6, size=12):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(4, 120))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("tile", [5, 1024])
def test_jaccard_is_exact(spark, tile):
    df = docs(spark, near_texts(3) + AWKWARD)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, tile=tile).collect()}
    assert got == brute_components(rows)


def test_jaccard_over_templates_of_many_sizes(spark):
    rng = random.Random(31)
    template = [f"t{i}" for i in range(150)]
    texts = []
    for i in range(60):
        own = [f"u{i}_{k}" for k in range(rng.randrange(10, 45))]
        texts.append(" ".join(template[: rng.randrange(100, 150)] + own))
        if i % 3 == 0:
            texts.append(texts[-1] + " z")
    df = docs(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, tile=4).collect()}
    assert got == brute_components([(i, t) for i, t in enumerate(texts)])


def test_words_that_polynomials_confuse_stay_apart(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "x" * 9, "x" * 10, "x" * 65, "x" * 66, "A" * 70, "a" * 70]
    got = [r["component_id"] for r in jaccard.jaccard_components(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 6]


@pytest.mark.parametrize(("sizes", "by"), [([30, 60, 120, 240, 480, 960, 1920, 3840], "halves"), ([200] * 8, "cells")])
def test_regions_are_parted_by_size_and_into_cells(sizes, by):
    rng = np.random.default_rng(5)
    sets = []
    for size in sizes:  # clusters far apart
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        for _ in range(25):
            keep = rng.random(len(base)) < 0.96
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, 3).astype(np.uint64)])))
    region = jaccard.Region(sets)
    region.join(np.arange(len(sets)), np.ones(len(sets), bool))
    plain = jaccard.Region(sets)
    plain._leaf(np.arange(len(sets)), np.ones(len(sets), bool))
    assert region.counts[by] > 0
    assert region.counts["pairs"] < 0.5 * plain.counts["pairs"]
    assert [region.root(i) for i in range(len(sets))] == [plain.root(i) for i in range(len(sets))]


def test_jaccard_awkward_rows(spark):
    rows = jaccard.jaccard_components(awkward(spark)).collect()
    assert len(rows) == 2 * len(AWKWARD)
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0
    clashing = docs(spark, ["a b c d e f", "a b c d e f", "g"]).withColumns({"__gone": F.lit(1), "first": F.lit(2), "node": F.lit(3)})
    assert sorted(r["doc_id"] for r in jaccard.keep_one(clashing).collect()) == [0, 2]
    kept = jaccard.keep_one(docs(spark, ["a b c d e f", "a b c d e f", "g"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and kept.columns == docs(spark, []).columns


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {150: 100, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_compact_windows_match_their_definition():
    rng = np.random.default_rng(1)
    for n in (5, 9, 40):
        for values in (3, 10**6):
            for least in (1, 2, 5):
                h = rng.integers(0, values, n).astype(np.uint64)
                want = set()
                for i in range(n):
                    for j in range(i + least - 1, n):
                        k = i + int(h[i : j + 1].argmin())
                        a = b = k
                        while a > 0 and h[a - 1] > h[k]:
                            a -= 1
                        while b < n - 1 and h[b + 1] >= h[k]:
                            b += 1
                        want.add((a, k, b))
                assert set(zip(*(x.tolist() for x in substrings.compact_windows(h, least)), strict=True)) == want


def test_repeated_passages(spark):
    rng = random.Random(5)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = words(60)
    edited = list(passage)
    edited[30] = "changed"
    texts = [" ".join(words(80) + passage + words(40)), " ".join(words(10) + passage + words(90)), " ".join(words(50) + edited), " ".join(words(200)), " ".join(words(30) + passage[:20] + words(30)), " ".join(words(70))]
    df = docs(spark, [*texts, texts[5], None, ""], id=F.lit(1))
    rows = substrings.repeated_passages(df).collect()
    assert {r["doc_id"] for r in rows} == {0, 1, 2, 5, 6}
    found = {r["doc_id"]: (r["first_word"], r["last_word"]) for r in rows}
    assert found[0] == (80, 139) and found[1] == (10, 69) and found[5] == (0, 69)
    assert substrings.repeated_passages(docs(spark, [])).count() == 0


def test_passages_that_recur_within_a_document(spark):
    rng = random.Random(6)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage, line, run = words(60), words(10), ["la"]
    texts = [words(20) + passage + words(30), words(40) + passage + words(70) + passage + words(15) + passage + words(9)]
    texts += [words(30) + line * 12 + words(20), words(55) + line * 30 + words(20)]
    texts += [words(10) + run * 100 + words(20), words(40) + run * 3000 + words(10), words(25) + run * 80 + words(60) + run * 90]
    rows = substrings.repeated_passages(docs(spark, [" ".join(t) for t in texts])).collect()
    found = {i: sorted((r["first_word"], r["last_word"]) for r in rows if r["doc_id"] == i) for i in range(len(texts))}
    assert found == {0: [(20, 79)], 1: [(40, 99), (170, 229), (245, 304)], 2: [(30, 149)], 3: [(55, 354)], 4: [(10, 109)], 5: [(40, 3039)], 6: [(25, 104), (165, 254)]}


def test_passages_whose_keys_other_documents_lead(spark):
    rng = random.Random(8)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts, want = [], set()
    for _ in range(25):
        p, q = words(52), words(60)
        # the first document holds too little of p, and q as the second does
        texts += [words(30) + p[4:44] + words(30) + q, q + words(30) + p + words(20), words(70) + p + words(30)]
        want |= {(len(texts) - 2, 90, 141), (len(texts) - 1, 70, 121)}
        # three loose variants before two equal ones
        p = words(52)
        texts += [words(30) + p[6 + i : 44 + i] + words(40) for i in range(3)] + [words(25) + p + words(50), words(60) + p + words(20)]
        want |= {(len(texts) - 2, 25, 76), (len(texts) - 1, 60, 111)}
    rows = substrings.repeated_passages(docs(spark, [" ".join(t) for t in texts])).collect()
    assert want <= {(r["doc_id"], r["first_word"], r["last_word"]) for r in rows}


def stretches_elsewhere(texts, least=50):
    """For each text the words that lie in a stretch of ``least`` words which another text holds word for word."""
    held = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - least + 1):
            held.setdefault(tuple(t[j : j + least]), set()).add(i)
    out = []
    for i, t in enumerate(texts):
        inside = set()
        for j in range(len(t) - least + 1):
            if held[tuple(t[j : j + least])] - {i}:
                inside.update(range(j, j + least))
        out.append(inside)
    return out


@pytest.mark.parametrize("group", [4, 512])
def test_every_exact_repeat_is_found(spark, group):
    rng = random.Random(21)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passages = [words(rng.randrange(50, 130)) for _ in range(12)]
    texts = []
    for _ in range(70):
        t = words(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 30)
            t += p[cut : cut + rng.randrange(50, 130)] + words(rng.randrange(0, 60))
        texts.append(t)
    texts += [words(100), texts[3], texts[3]]
    clean = len(texts) - 3
    rows = substrings.repeated_passages(docs(spark, [" ".join(t) for t in texts]), group=group).collect()
    assert all(r["partner"] != r["doc_id"] and 0 <= r["first_word"] <= r["last_word"] < len(texts[r["doc_id"]]) for r in rows)
    for i, want in enumerate(stretches_elsewhere(texts)):
        found = {w for r in rows if r["doc_id"] == i for w in range(r["first_word"], r["last_word"] + 1)}
        assert want <= found, i
        assert want or not found, i
    assert clean not in {r["doc_id"] for r in rows}


@pytest.mark.parametrize("group", [8, 512])
def test_nearly_equal_passages_are_found(spark, group):
    rng = random.Random(22)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts, passages = [], [words(80) for _ in range(10)]
    for i in range(60):
        p = list(passages[i % 10])
        p[rng.randrange(20, 60)] = f"v{i}"
        texts.append(words(30) + p + words(30))
    texts += [words(200) for _ in range(20)]
    rows = substrings.repeated_passages(docs(spark, [" ".join(t) for t in texts]), group=group).collect()
    assert len({r["doc_id"] for r in rows if r["doc_id"] < 60}) >= 58 and all(r["doc_id"] < 60 for r in rows)


def test_common_passages_with_a_word_changed_are_found(spark):
    """What nearly all documents hold is common in the sample; the changed word's shingles are not, and nobody else has them."""
    rng = random.Random(23)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage, texts = words(52), []
    for i in range(200):
        p = list(passage)
        p[26] = f"v{i}"
        texts.append(words(30) + p + words(30))
    df = docs(spark, [" ".join(t) for t in texts])
    assert len(substrings.common_shingles(df, "doc_id", "text")) > 30
    assert len({r["doc_id"] for r in substrings.repeated_passages(df).collect()}) >= 190


def test_passages_awkward_rows(spark):
    df = awkward(spark)
    rows = substrings.repeated_passages(df).collect()
    assert all(r["partner"] != r["doc_id"] for r in rows)
    none = docs(spark, []).withColumns({"id": F.lit(1), "key": F.lit(1), "at": F.lit(1), "partner": F.lit(1)})
    assert substrings.repeated_passages(none).count() == 0
    long = " ".join(f"w{i}" for i in range(200_000))
    assert [(r["doc_id"], r["first_word"], r["last_word"], r["partner"]) for r in substrings.repeated_passages(docs(spark, ["x " + long, "y z " + long])).orderBy("doc_id").collect()] == [(0, 1, 200_000, 1), (1, 2, 200_001, 0)]


def test_token_counts_splice_exactly():
    counter = token_counts.piece_counter(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(7)
    alphabet = ["a", "ab ", "  ", "é", "中", "\n", "x1", "😀", "the ", "ing", "▁", " ", "<s>"]
    for _ in range(500):
        some = rng.sample(alphabet, rng.randrange(1, 6))
        s = "".join(rng.choice(some) for _ in range(rng.randrange(300)))
        assert token_counts.count_tokens(counter, s, rng.choice([8, 20, 60]), rng.choice([2, 4, 8])) == len(counter.ids(s))


def test_token_count_documents(spark):
    rows = token_counts.count_documents(awkward(spark), public_tokenizers.path("piece_bpe_32k.model"), limit=100).collect()
    assert len(rows) == 2 * len(AWKWARD)
    for r in rows:
        assert r["n_bytes"] == len((AWKWARD[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 100)


def test_licenses(spark):
    noise = "lorem ipsum the of and to any " * 40
    texts = [noise + licenses.TEMPLATES["mit"] + noise, noise + "\nReleased under the MIT License.", noise, licenses.TEMPLATES["isc"].replace("any purpose", "a purpose").upper(), "all is reserved by rights", None, ""]
    rows = {r["doc_id"]: r for r in licenses.summarize(licenses.scan_licenses(docs(spark, texts))).collect()}
    assert rows[0]["license"] == "mit" and rows[0]["coverage"] == 1.0
    assert rows[1]["license"] == "mit-line" and rows[3]["license"] == "isc"
    assert [rows[i]["n_licenses"] for i in (2, 4, 5, 6)] == [0, 0, 0, 0]


def test_licenses_that_stand_twice_in_a_row(spark):
    line, mit = licenses.TEMPLATES["mit-line"], licenses.TEMPLATES["mit"]
    around = "The code is under the terms of the owner. {} See the file for any part of the permission."
    texts = ["The code is under the terms. Released under the MIT License. Released under the MIT License. See the file.", around.format(f"{line} {line} {line}"), around.format(f"{mit} {mit}")]
    rows = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    for i, (name, notice) in enumerate((("mit-line", line), ("mit-line", line), ("mit", mit))):
        found = next(x for x in rows[i] if x["name"] == name)
        assert found["coverage"] == 1.0 and texts[i][found["start"] : found["end"]] + "." == notice


def test_whole_notices_amid_their_own_words_are_found(spark):
    rng = random.Random(12)
    texts, names = [], []
    for _ in range(150):
        name = rng.choice(list(licenses.TEMPLATES))
        own = licenses.TEMPLATES[name].split()
        loose = lambda: " ".join(rng.choice(own) for _ in range(rng.randrange(40)))
        texts.append(f"{loose()} {licenses.TEMPLATES[name]} {loose()}")
        names.append(name)
    rows = licenses.scan_licenses(docs(spark, texts)).collect()
    assert all(names[r["doc_id"]] in {x["name"] for x in r["licenses"]} for r in rows)


def test_every_occurrence_of_a_notice_and_awkward_rows(spark):
    line = licenses.TEMPLATES["bsl-1.0"]
    text = f"one {line} some words between them {line} and more {line}"
    rows = licenses.scan_licenses(docs(spark, [text])).first()["licenses"]
    found = sorted((x["start"], x["end"]) for x in rows if x["name"] == "bsl-1.0")
    assert [text[a:b] + "." for a, b in found] == [line] * 3
    clashing = awkward(spark).withColumn("licenses", F.lit(1))
    assert licenses.summarize(licenses.scan_licenses(clashing)).where("n_licenses > 0").count() == 0
    assert licenses.scan_licenses(clashing).count() == 2 * len(AWKWARD) and licenses.scan_licenses(docs(spark, [])).count() == 0


def test_narrow_operators_on_empty_tables(spark):
    none = docs(spark, [])
    assert token_counts.count_documents(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert media.media_columns(none, with_hashes=True).count() == 0 and language.predict(none, None).count() == 0


def test_documents_of_the_queries_agree_with_the_libraries(spark):
    """ids_sha256 and n_tokens per document, as the libraries give them, huge and awkward texts among them."""
    tiktoken, sentencepiece = pytest.importorskip("tiktoken"), pytest.importorskip("sentencepiece")
    rng = random.Random(13)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    texts = [r["text"] for r in rows] + AWKWARD + [" ".join(rng.choice(["the", "naïve", "中文", "x" * 50, "12", "\n"]) for _ in range(250_000))]
    df = docs(spark, texts)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.text_encoder(path, public_tokenizers.PATTERN).v.ranks, special_tokens={})
    for r in bpe.encode_documents(df, path, public_tokenizers.PATTERN).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    piece = public_tokenizers.path("piece_bpe_32k.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=piece)
    for r in token_counts.count_documents(df, piece).collect():
        assert r["n_tokens"] == len(processor.encode(texts[r["doc_id"]] or ""))


def test_longest_common_agrees_with_a_plain_one():
    rng = random.Random(9)
    for _ in range(200):
        b = [rng.randrange(5) for _ in range(rng.randrange(1, 9))]
        a, at, width = [rng.choice(b) for _ in range(rng.randrange(1, 16))], [], rng.randrange(1, 12)
        for _ in a:
            at.append((at[-1] if at else 0) + rng.randrange(1, 3))
        want = 0
        for i in range(len(a)):
            row = [0] * (len(b) + 1)
            for x in (w for w, p in zip(a[i:], at[i:], strict=True) if p - at[i] <= width):
                last = 0
                for j, y in enumerate(b, 1):
                    row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
            want = max(want, row[-1])
        assert licenses.longest_common(a, b, width, at, 1)[0] == want


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = licenses.patience_align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_gru_gradient_is_right():
    net = language.ByteGru(["a", "b", "c"], 3)
    x, mask, label = language.segments_of(["hello", "wörld xyz", "q"], [0, 1, 2])
    x, mask = x[:12], mask[:12]
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, grads = net.gradient(x, mask, label)
    for name in ("uf", "ub", "o", "c", "wf", "wb"):
        flat = net.p[name].reshape(-1)
        for i in np.flatnonzero(np.abs(grads[name].reshape(-1)) > 1e-5)[:4]:
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = net.gradient(x, mask, label)[0]
            flat[i] = old - step
            down = net.gradient(x, mask, label)[0]
            flat[i] = old
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-5)


def test_language_on_held_out_documents(spark):
    df = queries.op6_language(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = df.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_language_awkward_rows(spark):
    train = docs(spark, ["the cat and the dog"] * 10).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    model = language.fit(train, epochs=1)
    rows = language.predict(awkward(spark), model, keep=["doc_id"]).collect()
    assert len(rows) == 2 * len(AWKWARD)
    for r in rows:
        letters = re.search(r"[^\W\d_]", AWKWARD[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (letters is None) and 0 <= r["score"] <= 1
    assert language.fit(docs(spark, [])) is None
    assert {r["lang_pred"] for r in language.predict(awkward(spark), None).collect()} == {"und"}


def test_mixing(spark):
    rows = [(i, f"t{i}", "en", "big" if i < 3000 else "small" if i < 3300 else None, 0) for i in range(3400)]
    df = spark.createDataFrame(rows, SCHEMA)
    once, again = (mixing.mix(d).select("doc_id", "copy_no", "mix_key").collect() for d in (df, df.repartition(7)))
    assert sorted(once) == sorted(again)
    means = {r["of"]: r["mean"] for r in mixing.source_means(df)[0].collect()}
    for source, n in (("big", 3000), ("small", 300), (None, 100)):
        count = mixing.mix(df).where(F.col("source").eqNullSafe(source)).count()
        assert abs(count - n * means[source]) < 5 * (n * means[source]) ** 0.5
    only = mixing.mix(df, weights={"small": 1.0}, scale=300.0)
    assert {r["source"] for r in only.select("source").distinct().collect()} == {"small"}
    assert abs(only.count() - 300 * 3400) < 5 * (300 * 3400) ** 0.5
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(awkward(spark)).count() >= 0


def test_media(spark):
    rows = media.media_columns(awkward(spark), with_media=True).collect()
    assert len(rows) == 2 * len(AWKWARD)
    for r in rows:
        raw = (AWKWARD[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        assert media.from_wav(bytes(r["media"])) == payload and r["payload_bytes"] == len(payload) and r["n_bytes"] == len(raw)
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_bytes"] == len(r["media"])
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(4000) / 8000)).astype(np.uint8)
    frames, bins = media.peaks(np.concatenate([np.full(2000, 128, np.uint8), tone]))
    assert len(frames) == 0 or set(bins[bins < 64].tolist()) <= {31, 32, 33}


def test_search_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(400, None), (401, [1.0] * 7 + [float("nan")]), (402, [float("inf")] * 8), (403, []), (404, rows[0][1]), (405, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = {}
    for r in kdtree.search(df, is_query=F.col("vec_id") % 20 == 0, k=6, shard_rows=90, block_queries=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if v and len(v) == 8 and np.isfinite(v).all()}
    for q in (i for i in ints if i % 20 == 0):
        best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:6]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert set(got) == {i for i in ints if i % 20 == 0}
    assert kdtree.search(df.limit(0), is_query=F.lit(True)).count() == 0


def test_carried_scores_spare_leaves():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 60
    points = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 6)
    splits = kdtree.Splits([points[i] for i in range(0, 6000, 5)], 6)
    cell, ids = splits.cells(points), np.arange(6000)
    assert len(np.unique(cell)) == 6
    queries = np.arange(0, 6000, 20)
    visits = {}
    for carry in (True, False):
        scores, found = np.full((len(queries), 10), -np.inf), np.full((len(queries), 10), np.iinfo(np.int64).max)
        visits[carry] = leaves = 0
        for c in range(6):
            tree = kdtree.KdTree(points[cell == c], ids[cell == c], leaf=32)
            leaves += len(tree.leaves)
            s, f = (scores, found) if carry else (np.full(scores.shape, -np.inf), np.full(found.shape, np.iinfo(np.int64).max))
            visits[carry] += tree.search(points[queries], queries, 10, s, f)
        if carry:
            assert (scores == -np.sort(-np.where(queries[:, None] == ids, -np.inf, points[queries] @ points.T), 1)[:, :10]).all()
    assert visits[True] < 0.6 * visits[False] and visits[True] < 0.5 * len(queries) * leaves


def test_search_with_repeated_ids_and_equal_vectors(spark):
    rows = [(i % 30, [float(i % 3), 1.0]) for i in range(120)] + [(100 + i, [1.0, 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in kdtree.search(df, is_query=F.col("vec_id") == 105, k=7, shard_rows=16).orderBy("rank").collect()]
    ints = [(i, [int(64 * x) for x in v]) for i, v in rows if i != 105]
    best = sorted((-(64 * v[0] + 64 * v[1]), i) for i, v in ints)[:7]
    assert got == [(105, k, i, -s) for k, (s, i) in enumerate(best, 1)]


def brute_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets_agree_with_plain_scans(spark):
    rng = random.Random(9)
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ": ", '"', "'", " ", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "xyz", "é", "\n", "-", "Secret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(150)] + AWKWARD + [" é ".join(f"{i:016x}" for i in range(3000))]
    rows = secrets.summarize(secrets.scan_secrets(docs(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute_spans(texts[r["doc_id"]] or "")
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert set(text.split(",")) <= set(r["spans"].split(",")) | {""}


def test_ownership_and_redaction(spark):
    copied, live = "password=examplevalue12", "password=mysecretvalue99"
    df = spark.createDataFrame([(i, f"x {copied} y", "en", f"s{i}", 0) for i in range(4)] + [(9, f"a {live} b {copied}", "en", "s9", 0), (10, None, "en", "s1", 0)], SCHEMA)
    rows = {r["doc_id"]: r for r in secrets.summarize(secrets.scan_secrets(df)).collect()}
    assert (rows[0]["n_live"], rows[0]["n_copied"]) == (0, 1) and (rows[9]["n_live"], rows[9]["n_copied"]) == (1, 1)
    texts = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    assert texts[0] == f"x {copied} y" and texts[9] == f"a [SECRET] b {copied}" and texts[10] is None
    assert secrets.scan_secrets(docs(spark, [])).count() == 0
    assert secrets.redact_secrets(awkward(spark)).count() == 2 * len(AWKWARD)


def test_pipeline_stages_on_awkward_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, none = awkward(spark), awkward(spark).limit(0)
    for name, stage in pipeline.STAGES:
        last = name == pipeline.STAGES[-1][0]
        out = stage(spark, rows, "")
        assert last or out.columns == rows.columns
        assert out.count() <= 2 * rows.count() and stage(spark, none, "").count() == 0
        if name in ("secrets", "encoding"):
            assert out.count() == rows.count()
        if name == "near_duplicates":
            assert out.where("text is null or trim(text) = ''").count() == rows.where("text is null or trim(text) = ''").count()


def plain_pipeline(spark, rows, model):
    """The five stages in plain Python: {doc_id: [(n_tokens, ids_sha256), ...]} of the copies."""
    tiktoken = pytest.importorskip("tiktoken")
    kept = []
    for i, text, _, source in rows:  # language: one text at a time through the network that is trained
        raw = np.frombuffer((text or "").encode(), np.uint8)
        if not text or not any(c.isalpha() for c in text):
            continue
        total = np.zeros(len(model.languages))
        for k in range(0, len(raw), language.SEGMENT):
            x = raw[k : k + language.SEGMENT].astype(np.int64)[:, None]
            mask = np.ones(x.shape, np.float32)
            total += model._scores(np.concatenate([model._run(d, x, mask)[0] for d in "fb"], -1))[:, 0].sum(0)
        if (total / len(raw)).max() >= 0.4:
            kept.append((i, text, source))
    label = brute_components([(i, t) for i, t, _ in kept])
    kept = [x for x in kept if label[x[0]][1] == x[0]]
    found, owners, repos = {}, {}, {}
    lang = {i: lang for i, _, lang, _ in rows}
    for i, text, source in kept:
        base = brute_spans(text)
        spans = [(a, b, re.search(secrets.ASSIGN, text[a:b])[2] if k == 0 else text[a:b]) for a, k, b in base]
        for m in re.finditer(secrets.BARE, text):
            if all(re.search(p, m[0]) for p in ("[a-z]", "[A-Z]", "[0-9]")) and not any(a < m.end() and m.start() < b for a, _, b in base):
                spans.append((m.start(), m.end(), m[0]))
        found[i] = sorted(spans)
        for _, _, value in spans:
            owners.setdefault(value, set()).add(source)
            repos.setdefault(value, set()).add((source, "/".join(x for x in (source, lang[i]) if x is not None)))
    masked = []
    for i, text, source in kept:
        out, at = "", 0
        for a, b, value in found[i]:
            if len(owners[value] - {None}) >= secrets.COPIED_FROM or len(repos[value]) >= secrets.COPIED_REPOS:
                continue
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        masked.append((i, out + text[at:], source))
    sizes = {}
    for _, _, source in masked:
        sizes[source] = sizes.get(source, 0) + 1
    factor = len(masked) / sum(n**0.5 for n in sizes.values())
    ranks = bpe.text_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).v.ranks
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for i, text, source in masked:
        mean = factor * sizes[source] ** 0.5 / sizes[source]
        u = int(hashlib.md5(f"7:{i}:1".encode()).hexdigest()[:12], 16) / 2**48
        p = below = np.exp(-mean)
        copies = 0
        while below <= u:
            copies += 1
            p *= mean / copies
            below += p
        ids = library.encode_ordinary(text)
        if copies:
            out[i] = [(len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] * copies
    return out


def test_pipeline_agrees_with_a_plain_one(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(150)
    extra = spark.createDataFrame([(90_000 + i, f"Some more words about the thing number {i}: password=examplevalue12 and token: live{i}secretvalue77", "en", f"x{i}", 0) for i in range(4)] + [(99_998, None, None, None, 0), (99_999, "", "en", None, 0)], SCHEMA)
    df.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).union(extra).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]
    got = {}
    for r in pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_sha256"]))
    assert got == plain_pipeline(spark, rows, language.fit(df))


def test_gru_labels_positions_as_it_was_trained():
    model = language.ByteGru(["a", "b", "c"], seed=8)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (40, 7))
    mask = (np.arange(40)[:, None] < np.array([40, 1, 17, 40, 33, 8, 25])).astype(np.float32)
    want = model._scores(np.concatenate([model._run(d, x, mask)[0] for d in "fb"], -1)) * mask[..., None]
    got = model.positions(x, mask).transpose(0, 2, 1) * mask[..., None]
    assert np.abs(got - want).max() < 1e-5


def test_language_learns_every_language(spark):
    alphabet = [chr(0x4E00 + 40 * i) for i in range(70)]
    rows = [(k * 100 + i, " ".join(c * 3 for _ in range(30)), f"l{k:02}", "s", 0) for k, c in enumerate(alphabet) for i in range(3)]
    sample = language.training_sample(spark.createDataFrame(rows, SCHEMA), "text", "lang", F.col("doc_id"))
    assert len({r["lang"] for r in sample}) == 70
    assert language.predict(docs(spark, []), language.ByteGru(["a", "b"])).count() == 0


def test_media_agrees_with_a_plain_fingerprint(spark):
    texts = ["hello world " * 60, "x", None, "".join(chr(32 + (i * i) % 90) for i in range(3000))]
    for r in media.media_columns(docs(spark, texts), with_hashes=True, with_media=True).collect():
        payload = media.payload_of(texts[r["doc_id"]])
        header = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") * 2 + (8000).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + b"data" + len(payload).to_bytes(4, "little")
        assert r["media"] == header + payload and r["media_sha256"] == hashlib.sha256(header + payload).hexdigest()
        samples = np.frombuffer(payload, np.uint8).astype(float) - 128
        frames = len(payload) // media.HOP
        padded = np.concatenate([samples, np.zeros(media.FRAME)])
        loud = np.array([np.abs(np.fft.rfft(padded[t * media.HOP : t * media.HOP + media.FRAME] * np.hanning(media.FRAME)))[1:] for t in range(frames)])
        found = []
        for t in range(frames):
            for low in (0, media.FRAME // 4):
                k = low + int(loud[t, low : low + media.FRAME // 4].argmax())
                if loud[t, k] > 1e-3 and (t == 0 or loud[t, k] > loud[t - 1, k]) and (t == frames - 1 or loud[t, k] >= loud[t + 1, k]):
                    found.append((t, k + 1))
        want = sorted(t << 32 | a << 16 | b << 8 | u - t for i, (t, a) in enumerate(found) for u, b in found[i + 1 : i + 1 + media.FAN] if u - t <= media.SPAN)
        assert len(set(want) ^ set(r["hashes"])) <= 0.02 * len(want)  # single precision may turn a tie
        assert r["feature"].split(":")[0] == str(len(r["hashes"]))


def test_word_hashes_tell_words_apart():
    from sparkloom.llm.common import text_buffers, words_of

    data, offsets = text_buffers(pa.array(["The  cat\tthe", None, "cat x"]))
    hashes, starts, ends, rows = words_of(data, offsets)
    assert rows.tolist() == [0, 3, 3, 4] and hashes[0] == hashes[2] and len(set(hashes.tolist())) == 3
    assert starts.tolist() == [0, 5, 9, 12] and ends.tolist()[:3] == [3, 8, 12]
