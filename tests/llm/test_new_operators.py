"""Alignment, importance resampling and language identification against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkgraph.llm import alignment, importance, language
from linkgraph.llm.vocabularies import byte_level_tokens, place

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
DOCS = "doc_id bigint, text string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, f"The {rng.choice(['quick', 'slow', 'Unübertroffene', 'наука'])} thing, number {rng.randrange(99)}.\nIt's {words(rng, rng.randrange(1, 60), 90)}") for i in range(40)]
    rows += [(50, None), (51, ""), (52, " "), (53, "  two  blanks\t and \n a tab "), (54, "x\n y\n  z \n"), (55, "字漢字 ひらがな 🙂🙃"), (56, "a▁b c"), (57, "<|endoftext|> <s> <0x41> [PAD]"), (58, "!!! ??? ..."), (59, "12 345")]
    rows += [(60, "ab" * 3000), (61, words(rng, 5000)), (62, " nbsp  em \x1c sep \x85 nel"), (63, "don't we'll I'M"), (64, "same text"), (65, "same text"), (65, "same text"), (None, "same text"), (66, "other\r\ntext  ")]
    return rows


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# -- alignment ----------------------------------------------------------------------------------


def plain_alignment(rows):
    """The definition, token by token, over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte_level = Tokenizer.from_file(place(A))
    byte_level.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=place(B))
    a_bytes = byte_level_tokens(A)
    linked, made = Counter(), []
    for id_, text in rows:
        ids_a, ids_b, groups = [], [], []
        if text:
            ids_a, ids_b = byte_level.encode(f" {text}", add_special_tokens=False).ids, model.encode(text)
            pieces = [model.id_to_piece(i) for i in ids_b]
            b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
            raw = f" {text}".encode()
            if b"".join(a_bytes[i] for i in ids_a) != raw or b"".join(b_bytes) != raw:
                ids_a, ids_b = [], []
            else:
                ends_a, ends_b = np.cumsum([len(a_bytes[i]) for i in ids_a]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
                both, own_a, own_b = set(ends_a) & set(ends_b), [], []
                at_b = iter(zip(ids_b, ends_b))
                for i, end in zip(ids_a, ends_a):
                    own_a.append(i)
                    if end in both:
                        for j, end_b in at_b:
                            own_b.append(j)
                            if end_b == end:
                                break
                        groups.append((own_a, own_b))
                        own_a, own_b = [], []
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        linked.update(links.keys())
        made.append((id_, ids_a, ids_b, groups, links))
    highest = defaultdict(int)
    for (i, _), n in linked.items():
        highest[i] = max(highest[i], n)
    out = []
    for id_, ids_a, ids_b, groups, links in made:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        n_best = sum(n for p, n in links.items() if linked[p] == highest[p[0]])
        out.append((id_, len(ids_a), len(ids_b), len(groups), sum(links.values()), n_best, sum(n * linked[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    total = sum((m[4] for m in made), Counter())
    return sorted(out, key=str), sorted((i, j, n, total[i, j], n == highest[i]) for (i, j), n in linked.items())


def check_alignment(spark, rows):
    result = alignment.align(frame(spark, rows), A, B)
    expected, pairs = plain_alignment(rows)
    assert sorted(map(tuple, alignment.digest(result).collect()), key=str) == expected
    assert sorted(map(tuple, result.pairs.collect())) == pairs


def test_alignment(spark, corpus):
    check_alignment(spark, corpus)


def test_alignment_in_small_blocks(corpus, monkeypatch):
    """Blocks, segments, large groups and a full memory of pieces, in one process."""
    for name, value in {"SEGMENT": 50, "SMALL_GROUP": 2, "MAX_PIECES": 30}.items():
        monkeypatch.setattr(alignment, name, value)
    alignment._PIECES.clear()
    expected, linked, n = plain_alignment(corpus)[0], Counter(), 0
    links = Counter()
    for start in range(0, len(corpus), 7):
        block = alignment.Block(alignment.pieces_for(A, B))
        rows = corpus[start : start + 7]
        for _, text in rows:
            block.add(text)
        stats, texts, pair, doc, times = block.close()
        found = [(id_, *s, hashlib.sha256(t.encode()).hexdigest() if t else "") for (id_, _), s, t in zip(rows, stats.T.tolist(), texts)]
        assert all(any(f[:5] == e[:5] and f[5] == e[7] for e in expected) for f in found)
        n += len(found)
        linked.update(pair.tolist())
        # planes give the documents and the multiplicities back
        got = Counter()
        for plane, pos, counts, bits in alignment.planes_of(np.unique(pair, return_inverse=True)[1], doc, times):
            docs = alignment.unpack_bitmaps(counts, bits)
            for p, d in zip(np.repeat(pos, counts).tolist(), docs.tolist()):
                got[p, d] += alignment.weight_of(plane)
        assert got == Counter(dict(zip(zip(np.unique(pair, return_inverse=True)[1].tolist(), doc.tolist()), times.tolist())))
        links.update(dict(zip(pair.tolist(), times.tolist())))
    assert n == len(corpus)
    alignment._PIECES.clear()


def test_alignment_of_long_runs(spark):
    """White space beyond what the rank encoder takes, and long words; the JSON tokenizer gives the ids."""
    check_alignment(spark, [(1, " " * 600_000), (2, "\n" * 600_000), (3, f"a{' ' * 500_000}b"), (4, "ab" * 100_000), (5, "\t \n" * 100_000)])


def test_alignment_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "one two", 7, "x")], "doc_id bigint, text string, n_a int, groups string")
    result = alignment.align(docs, A, B, keep=("doc_id", "n_a", "groups"), with_groups=True).documents
    assert result.columns == ["doc_id", *(c.split()[0] for c in alignment.DOCUMENT.split(", ")), "groups", "n_best", "count_sum"]
    row = result.first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and row["n_groups"] == 2
    assert alignment.digest(alignment.align(docs.limit(0), A, B)).count() == 0


def test_varints():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 65535, 5, 2**21 - 1])
    assert alignment.from_varints(alignment.varints(values)).tolist() == values.tolist()
    assert alignment.from_varints(b"").tolist() == []


# -- importance ---------------------------------------------------------------------------------


def plain_features(text, n):
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return found, [" ".join(found[i : i + k]) for k in range(1, n + 1) for i in range(len(found) - k + 1)]


def plain_importance(rows, target, n, buckets=10_000, percent=10, min_words=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in plain_features(text, n)[1]) for texts in ([r[1] for r in rows], target))
    S, T_ = sum(s.values()), sum(t.values())
    out = []
    for id_, text in rows:
        found, grams = plain_features(text, n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T_ + buckets)))) for b in map(bucket, grams))
        h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        out.append([id_, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(found) >= min_words])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(drawn[: percent * len(drawn) // 100])}
    return sorted([(*r[:4], rank.get(id(r))) for r in out], key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_importance(spark, corpus, n):
    rows = corpus + [(1000 + i, words(random.Random(i), 30, 50)) for i in range(60)]
    target = [None, "", "w1 w2 w3 w1 w2", words(random.Random(3), 50, 20)]
    got = importance.digest(importance.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), n=n, percent=35))
    assert sorted(map(tuple, got.collect()), key=str) == plain_importance(rows, target, n, percent=35)


def test_ngrams_over_blocks_of_words(monkeypatch):
    texts = ["a b c d e f g", "", "h i", None, "j", "k l m n o p q r s t"]
    expected = sorted((i, zlib.crc32(g.encode()) % 97) for i, t in enumerate(texts) for g in plain_features(t, 3)[1])
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(importance, "WORDS", size)
        got = [p for _, owner, hashes in importance.features([t.encode() if t else t for t in texts], 3, 97) for p in zip(owner.tolist(), hashes.tolist())]
        assert sorted(got) == expected


def test_importance_columns_ties_and_no_rows(spark):
    same = words(random.Random(1), 25)
    docs = spark.createDataFrame([(5, same, 1), (5, same, 2), (4, "short", 3)], "doc_id bigint, text string, score int")
    target = spark.createDataFrame([("w1",)], "text string")
    got = importance.resample(docs, target, keep=("doc_id", "score", "text"), percent=100)
    assert got.columns == ["doc_id", "text", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] or 0 for r in got.collect()) == [0, 1, 2]
    assert importance.resample(docs.limit(0), target.limit(0)).count() == 0


# -- language -----------------------------------------------------------------------------------

SOUNDS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "der"], "cc": ["tion", "ção", "ñe", "les"]}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def speech():
    rng = random.Random(2)
    rows = [(i, spoken(rng, lang, rng.randrange(3, 80)), lang) for i, lang in enumerate(rng.choice(sorted(SOUNDS)) for _ in range(300))]
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12, 13!", "cc"), (403, spoken(rng, "bb", 4000), "bb"), (404, spoken(rng, "aa", 30), None), (405, "ñ", None), (405, "ñ", None)]
    return rows


def test_language(spark, speech):
    docs = frame(spark, speech, "doc_id bigint, text string, lang string")
    net = language.train(docs.where(~language.held_out()), max_rows=120)
    got = language.identify(docs, net).withColumn("held", language.held_out()).collect()
    assert len(got) == len(speech)
    apart = [r for r in got if r["held"] and r["lang"] and r["text"] and any(map(str.isalpha, r["text"]))]
    assert len(apart) > 80 and sum(r["lang_pred"] == r["lang"] for r in apart) >= 0.97 * len(apart)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (400, 401, 402)} == {(i, "und", 0.0) for i in (400, 401, 402)}
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held"] for r in got)
    again = language.train(docs.where(~language.held_out()).repartition(7), max_rows=120)
    assert np.array_equal(again.out, net.out)  # the same rows give the same network


def test_network_reads_whole_texts(speech):
    """Windows, filters and votes against a plain walk over every place of every text."""
    rng = np.random.default_rng(0)
    net = language.fit(rng.integers(97, 123, (64, language.WINDOW)).astype(np.uint8), rng.integers(0, 2, 64), ["x", "y"], epochs=1)
    texts = ["a", "ab", "abc", "x" * 127, "y" * 128, "z" * 129, "Äb1 " * 400, speech[-4][1] or "q", "one TWO three"]
    got = language.windows_of([t.encode() for t in texts])
    for i, t in enumerate(texts):
        raw = language.FOLD[np.frombuffer(t.encode(), np.uint8)].tolist()
        step, at, expected = language.WINDOW - max(language.WIDTHS) + 1, 0, []
        while True:
            expected.append((raw[at : at + language.WINDOW] + [32] * language.WINDOW)[: language.WINDOW])
            if at + language.WINDOW >= len(raw):
                break
            at += step
        own = got[1] == i
        assert got[0][own].tolist() == expected
        for w, p in zip(expected, net.probabilities(got[0][own])):
            pooled = np.array([max(sum(filters[k][w[s + k]][f] for k in range(len(filters))) for s in range(language.WINDOW - len(filters) + 1)) for filters in net.filters for f in range(language.FILTERS)]) + net.bias
            assert np.allclose(p, net.softmax(pooled[None])[0], atol=1e-5)
    assert sum(got[2]) >= sum(len(t.encode()) for t in texts)


def test_gradients():
    """Each kind of parameter against finite differences."""
    rng = np.random.default_rng(1)
    windows, labels = rng.integers(97, 110, (8, 30)).astype(np.uint8), rng.integers(0, 3, 8)
    net = language.fit(windows, labels, ["x", "y", "z"], epochs=1)
    net.filters, net.bias, net.out, net.out_bias = [f.astype(float) for f in net.filters], net.bias.astype(float), net.out.astype(float), net.out_bias.astype(float)
    loss = lambda: -np.log(net.softmax(net.pooled(windows)[0])[np.arange(8), labels]).mean()
    found = language.gradients(net, windows, labels)
    for p, g in zip([*net.filters, net.bias, net.out, net.out_bias], found):
        for at in [np.unravel_index(i, p.shape) for i in [*np.argsort(-np.abs(g).ravel())[:4], 0]]:
            before, step = p[at], 1e-6
            p[at] = before + step
            high = loss()
            p[at] = before - step
            low = loss()
            p[at] = before
            assert abs((high - low) / (2 * step) - g[at]) < 1e-5


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None, "x"), (2, None, "en", "y")], "doc_id bigint, text string, lang string, score string")
    assert language.train(docs) is None
    got = language.identify(docs, None)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert [tuple(r)[-2:] for r in got.collect()] == [("und", 0.0)] * 2
    assert language.identify(docs.limit(0), None).count() == 0
    one = language.train(spark.createDataFrame([("only one", "en")] * 3, "text string, lang string"))
    assert language.identify(docs, one).where(F.col("lang_pred") == "en").count() == 1


# -- long runs of blanks, bounded training rows ---------------------------------------------------


def test_packing_of_long_white_space(spark):
    from tokenizers import Tokenizer

    from linkgraph.llm import packing

    tokenizer = Tokenizer.from_file(place(A))
    texts = [" " * 2_000_000, "\n" * 2_000_000, "\t" * 2_000_000, f"a <|endoftext|>{' ' * 600_000}b\n", "plain"]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert [[*ids, 0] for ids in packing.load_encoder("byte_bpe_50k.tiktoken")(texts)] == want
    got = packing.pack(frame(spark, list(enumerate(texts))), "byte_bpe_50k.tiktoken").orderBy("doc_id", "start").collect()
    for i, ids in enumerate(want):
        assert np.concatenate([np.frombuffer(r["token_bytes"], "<u4") for r in got if r["doc_id"] == i]).tolist() == ids


def test_has_long_blank():
    from linkgraph.llm import packing

    many = "a b\n" * 60_000
    assert not packing.has_long_blank(many) and not packing.has_long_blank("x" * 100_000)
    assert packing.has_long_blank(many + " " * 50_001 + "c") and not packing.has_long_blank(many + " " * 49_990 + "c")


def test_quality_trains_on_one_row_of_an_id(spark):
    """One rated id in 100,000 rows: the text with the smallest hash is the one that counts."""
    from linkgraph.llm import quality

    docs = spark.range(100_000, numPartitions=4).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, "other text"), (3, None)], DOCS))
    ratings = spark.createDataFrame([(1, 2), (2, 0), (2, 0), (3, 1), (4, 2)], "doc_id bigint, grade int")
    seen = []
    original = quality.fit_ordinal

    def spy(rows, grades, *rest):
        seen.append((rows, grades))
        return original(rows, grades, *rest)

    quality.fit_ordinal = spy
    try:
        quality.train(docs, ratings, dims=1 << 12)
        quality.train(docs, ratings, dims=1 << 12, max_features=1)
    finally:
        quality.fit_ordinal = original
    text = docs.where("doc_id = 1").orderBy(F.xxhash64("text"), "text").first()["text"]
    features = quality.featurizer(1 << 12)
    assert [r.tolist() for r in seen[0][0]] == [features(t).tolist() for t in (text, "other text", "other text", None)]
    assert seen[0][1].tolist() == [2, 0, 0, 1] and len(seen[1][0]) == 0


def test_quality_scores_and_gradient(spark):
    """Scores by hand from fixed weights, and the gradient of the likelihood against finite differences."""
    from linkgraph.llm import quality

    rng = np.random.default_rng(3)
    model = quality.OrdinalModel(rng.normal(0, 0.5, 512).astype(np.float32), np.array([-0.4, 0.9]))
    texts = [None, "", "One two TWO three", "UPPER 123 $$$ elephants", "ñandú " * 50]
    for row in quality.score(frame(spark, list(enumerate(texts))), model).collect():
        t = texts[row["doc_id"]] or ""
        found = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        raw = t.encode()
        letters = sum(b in range(65, 91) or b in range(97, 123) or b >= 128 for b in raw)
        share = lambda n, of: n / max(1, of)
        shape = {
            "length": int(math.log2(max(1, len(raw)))), "variety": int(10 * share(len(set(found)), len(found))), "upper": int(10 * share(sum(65 <= b <= 90 for b in raw), letters)),
            "digit": int(20 * min(0.5, share(sum(48 <= b <= 57 for b in raw), len(raw)))), "symbol": int(40 * min(0.25, share(sum(chr(b) in "!#$%&*+/<=>?@\\^_`{|}~" for b in raw), len(raw)))),
        }
        keys = [w.encode() for w in set(found)] + [b"\1" + w[:5].encode() for w in set(found) if len(w.encode()) > 5] + [f"\0{k}={v}".encode() for k, v in shape.items()]
        total = sum(float(model.weights[i]) for i in {zlib.crc32(k) % 512 for k in keys})
        tails = [1 / (1 + math.exp(cut - total)) for cut in model.thresholds]
        assert abs(row["expected_grade"] - sum(tails)) < 1e-6 and abs(row["p_top"] - tails[1]) < 1e-6

    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 9))) for _ in range(30)]
    grades, index, owner = rng.integers(0, 4, 30), np.concatenate(rows), np.repeat(np.arange(30), [len(r) for r in rows])
    model = quality.OrdinalModel(rng.normal(0, 1, 40), np.array([-1.0, 0.2, 1.1]))

    def loss():
        tails = model.tails(np.bincount(owner, weights=model.weights[index], minlength=30))
        padded = np.column_stack([np.ones(30), tails, np.zeros(30)])
        return -np.log(padded[np.arange(30), grades] - padded[np.arange(30), grades + 1]).mean()

    for values, gradient in zip((model.weights, model.thresholds), quality.likelihood_gradient(model, index, owner, grades)):
        for i in range(len(values)):
            before = values[i]
            values[i] = before + 1e-6
            high = loss()
            values[i] = before - 1e-6
            low = loss()
            values[i] = before
            assert abs((high - low) / 2e-6 - gradient[i]) < 1e-5
