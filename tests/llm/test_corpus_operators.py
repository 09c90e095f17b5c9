"""Each corpus operator against a plain version, on small tables with nulls, ties, repeated rows, very long
texts, no rows, and extra columns whose names clash with those an operator adds."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkgraph.llm import ann, anchors, decontam, linetemplates, neardup, packing, quality, repeats, sharding, toolcalls, warc

DOCS = "doc_id bigint, text string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, shared passages, long and odd ones."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(5, 120)) for _ in range(40)]
    rows = list(enumerate(base))
    n = len(rows)
    rows += [(n + i, base[i]) for i in range(6)]
    near = base[8].split()
    for i in range(6):
        copy = list(near)
        copy[rng.randrange(len(copy))] = "other"
        rows.append((n + 10 + i, " ".join(copy)))
    passage = words(rng, 60)
    rows += [(n + 20 + i, f"{words(rng, 9)} {passage} {words(rng, 7)}") for i in range(4)]
    rows += [(100, None), (101, ""), (102, "  \n\t "), (103, "Ünïcode Text, ÄÖÜ 字 and more"), (104, "one"), (105, "one two"), (106, "ONE two"), (107, "ab" * 4000), (108, words(rng, 9000)), (None, base[0]), (None, "none of it"), (7, base[7]), (7, "another text of seven " + words(rng, 30))]
    return rows


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# -- repeats ------------------------------------------------------------------------------------


def plain_repeats(rows, width=50):
    top = 1 << 70
    first = {}
    for id_, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - width + 1):
            k = data[s : s + width]
            first[k] = min(first.get(k, top + 1), top if id_ is None else id_)
    out = []
    for id_, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            if first[data[s : s + width]] < (top if id_ is None else id_):
                gone[s : s + width] = b"\1" * width
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((id_, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark, corpus):
    got = repeats.digest(repeats.remove_repeats(frame(spark, corpus))).collect()
    assert sorted(map(tuple, got), key=str) == plain_repeats(corpus)


def test_repeats_of_pieces(corpus, monkeypatch):
    """Texts longer than a piece, blocks smaller than a text."""
    monkeypatch.setattr(repeats, "PIECE", 200)
    rows = list(enumerate(t for _, t in corpus if t and len(t) < 3000))
    spans = {}
    for texts, ids, _, offsets in repeats._pieces([r[0] for r in rows], [0] * len(rows), [r[1] for r in rows]):
        t, _, _, first, last = anchors.runs(texts)
        for i, a, b in zip(ids[t], first + offsets[t], last + offsets[t]):
            spans.setdefault(int(i), []).extend(range(a, b + 1))
    for id_, text in rows:
        assert sorted(spans.get(id_, [])) == list(range(max(0, len(text.encode()) - 49)))


def in_process(rows, passes):
    """The operator's steps on one machine, with the sizes that a test has set in the module."""
    import pyarrow as pa

    texts = pa.record_batch({"id": pa.array([r[0] for r in rows], pa.int64()), "tag": pa.array([0] * len(rows), pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})

    def settle(batches, fn):
        cols = [np.concatenate(c) for c in zip(*[[x.to_numpy() for x in b.columns] for b in batches])]
        order = np.lexsort((cols[2], cols[1], cols[0]))
        parts = [pa.record_batch([pa.array(c[order][i : i + 7]) for c in cols], names=["key", "part", "id", "place"]) for i in range(0, len(order), 7)]
        return [r for b in fn(iter(parts)) for r in b.to_pylist()]

    found = []
    for n in range(passes):
        runs, look = settle(repeats.anchor_rows(passes, n)(iter([texts])), repeats.settled), {}
        for r in runs:
            if not r["dup"]:
                look.setdefault(r["id"], []).append(r["at"])
        asked = [(i, t, look[i]) for i, t in rows if i in look]
        windows = pa.record_batch({"id": pa.array([r[0] for r in asked], pa.int64()), "tag": pa.array([0] * len(asked), pa.int64()), "text": pa.array([r[1] for r in asked]), "look": pa.array([r[2] for r in asked], pa.list_(pa.int64()))})
        found += [r for r in runs if r["dup"]] + settle(repeats.window_rows(iter([windows])), repeats.settled_windows)
    out = []
    for id_, text in rows:
        data = text.encode()
        spans = repeats.merge([r["at"] for r in found if r["id"] == id_])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + data[at:a], b
        kept += data[at:]
        out.append((id_, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("combine, hot, portion", [(1 << 19, 64, 200_000), (60, 3, 20), (200, 4, 7)])
def test_repeats_of_a_common_phrase(monkeypatch, combine, hot, portion):
    """A phrase of 30 bytes in many surroundings, a passage of 70 in many others, one very long text, copies."""
    monkeypatch.setattr(repeats, "COMBINE", combine)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PORTION", portion)
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    rng = random.Random(3)
    phrase, passage = "in accordance with the terms of", " ".join(f"passage{i}" for i in range(8))
    texts = [f"{words(rng, 6)} {phrase} {words(rng, 8, 9)}" for _ in range(60)]
    texts += [f"{words(rng, 5)} {passage} {words(rng, 5)}" for _ in range(20)]
    texts += [words(rng, 9, 5) + f" {phrase} " * 40 + words(rng, 3000) + passage, texts[3], texts[70] + "!", "ab" * 300, "xab" * 100 + "ab" * 100]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert in_process(rows, 1) == in_process(rows, 3) == plain_repeats(rows)


def test_repeats_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


# -- near-duplicates ----------------------------------------------------------------------------


def plain_components(rows, k, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[root(i)] = min(id_, least.get(root(i), id_))
    out = []
    for i, (id_, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else id_
        out.append((id_, len(sets[i]), c, c is None or id_ == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("k,similarity,broadcast", [(3, 0.85, 500_000), (5, 0.8, 500_000), (3, 0.85, 0)])
def test_near_duplicates(spark, corpus, monkeypatch, k, similarity, broadcast):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", broadcast)
    got = neardup.near_duplicates(frame(spark, corpus), shingle=k, similarity=similarity).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(corpus, k, round(100 * similarity))


@pytest.mark.parametrize("classes, shingles", [(16, 1 << 21), (256, 1500)])
def test_near_duplicates_of_one_large_group(spark, monkeypatch, classes, shingles):
    """A bucket far over SMALL, whose members are near the limit of similarity: block against block."""
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "BLOCK", classes)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    rng = random.Random(3)
    base = words(rng, 120, 5000).split()
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 8])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = neardup.near_duplicates(frame(spark, rows), shingle=3, similarity=0.85).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows, 3, 85)


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert neardup.near_duplicates(frame(spark, [(1, None), (None, "")])).count() == 2


def test_dropping_keeps_columns(spark, corpus):
    docs = frame(spark, corpus).withColumn("kept", F.lit("x")).withColumn("component_id", F.lit(None).cast("string"))
    out = neardup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id is null").count() == 2  # rows without an id are never dropped


def test_fewest_matches():
    assert neardup.fewest_matches(25, 0.85, 1e-5) < 21
    for n in (25, 125):
        m = neardup.fewest_matches(n, 0.85, 1e-5)
        assert 0 < m < n and m <= neardup.fewest_matches(n, 0.85, 1e-2)


# -- decontamination ----------------------------------------------------------------------------


def plain_contamination(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = {}
    for item, text in items:
        w = split(text)
        if item is None or not w:
            continue
        m = min(window, len(w))
        for i in range(len(w) - m + 1):
            patterns.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for id_, text in docs:
        w, hit, owners = split(text), set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(w) - m + 1):
                if (p := tuple(w[i : i + m])) in patterns:
                    hit.update(range(i, i + m))
                    owners |= patterns[p]
        out.append((id_, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_contamination(spark, corpus, block_words):
    items = [(i, t) for i, t in enumerate(" ".join((t or "").split()[3:25]) for _, t in corpus[:14])] + [(3, "ONE, two"), (50, "字"), (51, None), (None, "one"), (52, "..."), (2, corpus[20][1])]
    docs = frame(spark, corpus)
    got = decontam.digest(decontam.mark_contamination(docs, frame(spark, items, "item_id bigint, text string"), block_words=block_words)).collect()
    assert sorted(map(tuple, got), key=str) == plain_contamination(corpus, items)


def test_contamination_without_benchmark_and_with_clashing_columns(spark, corpus):
    docs = frame(spark, corpus).withColumn("n_words", F.lit("x")).withColumn("hit_items", F.lit(1))
    out = decontam.mark_contamination(docs, spark.createDataFrame([], "item_id bigint, text string"))
    assert out.where(F.size("hit_spans") > 0).count() == 0 and out.count() == len(corpus)
    assert decontam.decontaminate(docs, spark.createDataFrame([(1, "one two")], "item_id bigint, text string")).columns == docs.columns


# -- packing ------------------------------------------------------------------------------------


def check_packing(rows, pieces, encode, size=1024):
    per_doc, per_seq = {}, {}
    for p in pieces:
        per_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        per_seq.setdefault(p.sequence_id, []).append(p)
    for ps in per_seq.values():
        ps.sort(key=lambda p: p.offset)
        at = 0
        for p in ps:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
    total = 0
    texts = {}
    for id_, text in rows:
        ids = [*encode([text or ""])[0], 0]
        total += len(ids)
        texts.setdefault(id_, []).append(ids)
    assert sum(p.length for p in pieces) == total
    for id_, lists in texts.items():
        if len(lists) == 1:
            got = sorted(per_doc[id_, len(lists[0])], key=lambda p: p.start)
            assert [p.start for p in got] == [sum(x.length for x in got[:i]) for i in range(len(got))]
            assert b"".join(bytes(p.token_bytes) for p in got) == np.array(lists[0], "<u4").tobytes()
    return total, len(per_seq)


def test_packing(spark, corpus):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = packing.load_encoder(path)
    pieces = packing.pack(frame(spark, corpus, parts=20), path, slots=4, fan_in=3).collect()
    total, sequences = check_packing(corpus, pieces, encode)
    assert sequences * 1024 - total < 0.05 * total + 1024


def test_rank_file_gives_the_tokenizers_ids(corpus):
    import public_tokenizers

    fast, plain = (packing.load_encoder(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("tiktoken", "json"))
    texts = [t or "" for _, t in corpus] + ["<|endoftext|> is text", "a\r\n\t  b", "​🙂 don't DON'T 12345"]
    assert fast(texts) == plain(texts)


def test_added_tokens_in_texts_give_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>  \n a", "a  <|endoftext|>\n\n<|endoftext", "x<|endoftext|>'s don't", ""]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [31373, 220, 50256, 995]
    assert packing.load_encoder(path)(texts) == packing.load_encoder(public_tokenizers.path("byte_bpe_50k.json"))(texts) == want
    check_packing(list(enumerate(texts)), packing.pack(frame(spark, list(enumerate(texts))), path).collect(), lambda ts: [tokenizer.encode(t, add_special_tokens=False).ids for t in ts])


def test_packing_keeps_columns_but_those_of_pieces(spark, corpus):
    import public_tokenizers

    docs = frame(spark, corpus[:20]).withColumn("offset", F.lit("mine")).withColumn("k0", F.lit("x")).withColumn("closed", F.lit("y"))
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=("k0", "doc_id", "offset", "closed"))
    assert pieces.columns[:3] == ["k0", "doc_id", "closed"] and len(set(pieces.columns)) == len(pieces.columns)
    assert {(r.k0, r.closed) for r in pieces.collect()} == {("x", "y")} and pieces.where("offset = 0").count() > 0


def test_packing_empty(spark):
    import public_tokenizers

    assert packing.pack(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


# -- sharding -----------------------------------------------------------------------------------


def test_sharding(spark, corpus):
    docs = frame(spark, corpus).withColumn("slot", F.lit("x"))
    out = sharding.shuffle_into_shards(docs, shards=5, bucket_bytes=2000).collect()
    assert len(out) == len(corpus)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r.slot)
        assert r.grown_shard in (r["shard"], 5) and r["size"] == len((r.text or "").encode()) + 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shuffle_into_shards(frame(spark, corpus, parts=7), shards=5, bucket_bytes=2000).collect()
    assert {(r.doc_id, r.text, r["shard"]) for r in out} == {(r.doc_id, r.text, r["shard"]) for r in again}
    assert sharding.shuffle_into_shards(spark.createDataFrame([], DOCS)).count() == 0


def test_sharding_law(spark):
    ids = spark.range(4000).select(F.col("id"), sharding.shard_of(F.col("id"), 24, 1).alias("s"), sharding.shard_of(F.col("id"), 25, 1).alias("g"))
    counts = [r["count"] for r in ids.groupBy("s").count().collect()]
    assert len(counts) == 24 and max(counts) < 1.5 * 4000 / 24
    assert ids.where("s <> g and g <> 24").count() == 0


def test_written_shards_keep_the_order(spark, corpus, tmp_path):
    path = str(tmp_path / "shards")
    out = sharding.shuffle_into_shards(frame(spark, corpus), shards=3, bucket_bytes=4000, path=path)
    slots = {(r["shard"], r.bucket, r["at"]): None for r in spark.read.parquet(path).select("shard", "bucket", "at").collect()}
    assert len(slots) == len(corpus) == out.count()
    for file in spark.read.parquet(path).inputFiles():
        at = [(r.bucket, r["at"]) for r in spark.read.parquet(file).collect()]
        assert at == sorted(at)


def test_sharding_of_one_row_many_times(spark):
    rows = [(7, "the same text " * 5)] * 900 + [(i, f"text {i}") for i in range(300)]
    out = sharding.shuffle_into_shards(frame(spark, rows), shards=4, bucket_bytes=3000).collect()
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert sorted((r.doc_id, r.text) for r in out) == sorted(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mine = sorted(r.slot for r in out if r.doc_id == 7 and r.text.startswith("the"))
    assert len({r["shard"] for r in out if r.doc_id == 7}) == 1 and mine[-1] - mine[0] > len(mine)  # spread over buckets of the shard


# -- WARC ---------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def test_warc_round_trip(spark):
    big, other = "<p>" + "ä" * 700, "x" * 1000
    rows = [(1, "http://www.A.example.com:80/p?q=1#f", big), (5, "https://a.example.com/p?q=1", big), (3, None, big), (2, "http://b.example/", other), (4, "no url", "x" * 999), (6, "no url", "x" * 999), (7, "http://b.example/", None), (8, "", ""), (None, "http://n.example/", other), (9, "http://b.example/z", "\r\n\r\nWARC/1.1\r\n"), (5, "https://a.example.com/p?q=1", big)]
    rows += [(100 + i, "http://hot.example/", f"page {i}") for i in range(50)]
    got = {}
    for r in warc.digest(warc.round_trip(spark, frame(spark, rows, PAGES).withColumn("payload", F.lit(1)))).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for page_id, _, html in rows:
        body = (html or "").encode()
        for r in got[page_id]:
            assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert [(got[i][0].record_type, got[i][0].refers_to) for i in (1, 3, 5, 4, 6)] == [("revisit", 5), ("revisit", 5), ("response", None), ("response", None), ("response", None)]
    assert len(got[5]) == 2 and {r.record_type for r in got[5]} == {"response"}
    assert got[None][0].refers_to == 2
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_revisits_do_not_depend_on_the_join(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org/{i}", ("a" * 1200, "b" * 1500, "c" * 10, None)[i % 4]) for i in range(60)] + [(None, "u", "a" * 1200), (3, "v", "d" * 2000), (3, "v", "d" * 2000), (None, "w", "e" * 1100), (None, "x", "e" * 1100)]
    pages = frame(spark, rows, PAGES)
    some = lambda: sorted(map(str, warc.with_revisits(pages, 1000).select("page_id", "url", "digest", "refers_to").collect()))
    by_broadcast = some()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert some() == by_broadcast and len(by_broadcast) == len(rows)
    assert sum("refers_to=56" in r for r in by_broadcast) == 15 and sum("refers_to=57" in r for r in by_broadcast) == 14


def test_index_finds_captures_over_blocks_and_files(spark, tmp_path):
    rows = [(f"k{i % 7:02d}", i, "a", i * 10, 5) for i in range(200)]
    captures = spark.createDataFrame(rows, warc.CAPTURE)
    root = f"file://{tmp_path}/index"
    index = warc.write_index(captures, root, files_=3, block_lines=8)
    keys = spark.createDataFrame([("k03",), ("k06",), ("nothing",), ("",)], "url_key string")
    got = warc.look_up(keys, index, root).collect()
    assert sorted(r.page_id for r in got) == [i for i in range(200) if i % 7 in (3, 6)]


@pytest.mark.parametrize("url,key", [("http://www.x.org:80/a?b#c", "org,x)/a?b"), ("https://x.org:8443", "org,x:8443)/"), ("nothing", "nothing"), (None, ""), ("http://[bad", "http://[bad")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


# -- nearest neighbours -------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>"


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in (centres[i % 20] + 0.3 * rng.normal(size=16)).astype(np.float32)]) for i in range(600)]
    same = rows[50][1]
    rows += [(1000 + i, same) for i in range(300)]  # a vector that a third of the rows hold
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] + [1.0] * 15), (2200, [float("inf")] + [1.0] * 15), (2250, [1.0]), (None, same), (1000, same)]
    got = ann.nearest(frame(spark, rows, VECTORS).withColumn("cell", F.lit("x")), share=0.6, centroids=8, shard_rows=200).collect()
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, m = np.array(sorted(good)), np.array([good[i] for i in sorted(good)])
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in good if i % 50 == 0}
    hit = 0
    for q, rows_ in found.items():
        rows_.sort()
        s = m @ good[q] / (np.linalg.norm(m, axis=1) * np.linalg.norm(good[q]))
        s[ids == q] = -9
        want = ids[np.lexsort((ids, -np.round(s, 12)))[:5]].tolist()
        assert [r[0] for r in rows_] == [1, 2, 3, 4, 5]
        assert all(abs(s[ids == v][0] - score) < 1e-12 for _, v, score in rows_)
        hit += len(set(want) & {r[1] for r in rows_})
    assert hit >= 0.9 * 5 * len(found)
    assert [v for _, v, _ in found[1000]] == [50, 1001, 1002, 1003, 1004]


def test_nearest_by_default_on_more_vectors(spark):
    """Recall of isotropic vectors, the worst case, with the index's own settings."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(3000, 32))
    got = {}
    for r in ann.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.9 * 5 * 60


def test_nearest_of_tiny_and_huge_vectors(spark):
    v = np.array([1.0, 2.0, -3.0])
    rows = [(0, v), (1, v * 2.0**-1000), (2, v * 2.0**900), (3, [0.0, 0.0, 5e-324]), (4, -v), (5, [0.0, 0.0, 0.0])]
    got = ann.nearest(frame(spark, [(i, [float(x) for x in r]) for i, r in rows], "vec_id bigint, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4] and got[0].score == got[1].score and abs(got[0].score - 1) < 1e-15 and abs(got[2].score + 3 / 14**0.5) < 1e-15


def test_nearest_few_or_none(spark):
    assert ann.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert ann.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])], VECTORS)).count() == 1


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(6), rng.random(5)
    counts = np.ones(30, int)
    counts[7] = 0
    sums = (a[:, None] + b[None, :]).ravel()
    assert ann.cells_in_order(a, b, counts, 29) == [c for c in np.argsort(sums) if c != 7]


# -- quality ------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        kind = rng.choice([0, 1, 2, 2, 2])
        text = words(rng, 60, 900)
        text = " ".join(f"{w}$$$ {w.upper()}!!" for w in text.split()) if kind == 0 else text + f" badword{rng.choice(['a', 'xy', 'q'])} rest" if kind == 1 else text
        rows.append((i, text))
        if i < 600:
            labels.append((i, int(kind > 0), int(kind == 1)))
        else:
            rows[-1] = (i, text, kind)
    held = {r[0]: r[2] for r in rows[600:]}
    docs = frame(spark, [(r[0], r[1]) for r in rows])
    grades = quality.grades_of(frame(spark, labels + [(1, None, 0), (2, 1, None), (9999, 1, 0)], "doc_id bigint, quality int, toxic int"))
    model = quality.train(docs, grades, dims=1 << 14)
    assert (np.diff(model.thresholds) >= 0).all()
    scored = {r.doc_id: r for r in quality.score(docs.withColumn("p_top", F.lit("x")), model).collect()}
    right = [(scored[i].p_top >= 0.5) == (kind == 2) for i, kind in held.items()]
    assert np.mean(right) > 0.95
    means = [np.mean([scored[i].expected_grade for i, k in held.items() if k == kind]) for kind in range(3)]
    assert means == sorted(means)


def test_quality_edges(spark, corpus):
    nothing = spark.createDataFrame([], "doc_id bigint, grade int")
    model = quality.train(frame(spark, corpus), nothing, dims=1024)
    scored = quality.score(frame(spark, corpus), model)
    assert quality.select(scored).count() == len(corpus)  # no ratings: no evidence against any row
    assert quality.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_quality_of_long_texts_and_double_ratings(spark):
    rng = random.Random(6)
    long = words(rng, 400_000, 900)
    rows = [(0, long), (1, long + " badword"), (2, "fine text " * 20), (3, "bad $$$ " * 20)]
    ratings = [(2, 2), (2, 2), (3, 0), (2, 0), (3, 0)]
    model = quality.train(frame(spark, rows), frame(spark, ratings, "doc_id bigint, grade int"), dims=1 << 12)
    scored = {r.doc_id: r.p_top for r in quality.score(frame(spark, rows), model).collect()}
    assert len(scored) == 4 and all(0 <= p <= 1 for p in scored.values()) and scored[2] > scored[3]


# -- line templates -----------------------------------------------------------------------------


def test_line_templates(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        lines = [" ".join("w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(9)) for _ in range(6)]
        lines.insert(rng.randrange(6), f"Posted on 2024-{i:02d} by user {i} in forum news")
        lines.insert(rng.randrange(6), f"Share this page with {rng.choice(['tom', 'ann', 'bob', 'eve'])} right now please")
        lines.insert(rng.randrange(6), "")
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[5][1].replace("Posted", "Also")) for i in range(20)]  # copies of one document
    rows += [(200, None), (201, ""), (None, rows[3][1]), (202, "one line only")]
    out = {(r.doc_id, r.text): r for r in linetemplates.drop_recurring_lines(frame(spark, rows).withColumn("n_dropped", F.lit("x"))).collect()}
    text = {}
    for (id_, t), _ in out.items():
        text.setdefault(id_, []).append(t)
    assert text[200] == [None] and text[201] == [""] and text[202] == ["one line only"]
    assert "Posted on" in text[0][0] and all("Posted on" not in text[i][0] for i in range(1, 60))
    assert sum("Share this page" in text[i][0] for i in range(60)) <= 4
    for i in range(60):
        own = [x for x in dict(rows)[i].split("\n") if x.startswith("w")]
        assert [x for x in text[i][0].split("\n") if x.startswith("w")] == own  # what is said once stays
    assert linetemplates.drop_recurring_lines(spark.createDataFrame([], DOCS)).count() == 0


def said(rng, n=9):
    return " ".join("w" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def without_lines(spark, rows):
    return {r.doc_id: r.text.split("\n") for r in linetemplates.drop_recurring_lines(frame(spark, rows)).collect()}


def plain_recurring(rows, least=8):
    """For rows whose lines are all their own template: those of enough documents that differ beside common lines."""
    lines = {i: t.split("\n") for i, t in rows}
    holders = {}
    for i, ls in lines.items():
        for x in ls:
            holders.setdefault(x, set()).add(i)
    rare = {i: tuple(sorted(x for x in ls if len(holders[x]) < least)) or ("all", *sorted(ls)) for i, ls in lines.items()}
    recurs = {x: min(h) for x, h in holders.items() if len({rare[i] for i in h}) >= least}
    return {i: [x for x in ls if recurs.get(x, i) == i] for i, ls in lines.items()}


def test_recurring_passages_of_several_lines(spark):
    rng = random.Random(21)
    header, block, footer, limit = ([said(rng) for _ in range(n)] for n in (2, 5, 2, 3))
    rows = []
    for i in range(40):
        lines = [*header, *[said(rng) for _ in range(3)], *block, *[said(rng) for _ in range(3)], *footer]
        if i < 8:
            lines[4:4] = limit[:2]  # two lines of exactly 8 documents, one of 7
        if i < 7:
            lines[4:4] = limit[2:]
        rows.append((i, "\n".join(lines)))
    copied = "\n".join(said(rng) for _ in range(6))
    rows += [(100 + i, copied) for i in range(12)]
    out = without_lines(spark, rows)
    assert out == plain_recurring(rows)
    assert all(not {*header, *block, *footer, *limit[:2]} & set(out[i]) for i in range(1, 40)) and limit[2] in out[6]
    assert all(out[100 + i] == copied.split("\n") for i in range(12))


def test_different_lines_of_one_opening_stay(spark):
    rng = random.Random(22)
    rows = []
    for i in range(60):
        lines = [f"I went to the {said(rng, 1)}", f"We came from a {said(rng, 2)}", f"They sat by the {said(rng, 2)} today", f"You ran to my {said(rng, 3)} today"]
        rows.append((i, "\n".join([said(rng), *rng.sample(lines, 4), said(rng)])))
    assert without_lines(spark, rows) == plain_recurring(rows) == {i: t.split("\n") for i, t in rows}


def plain_templates(rows, depth=4, agree=0.6, least=8, min_tokens=3):
    """The whole operator in plain Python: for each document the lines that stay."""
    import math
    from collections import Counter, defaultdict

    lines = {}
    for i, t in rows:
        masked = [" ".join(re.sub("[0-9]+", "0", x).split()) for x in t.split("\n")]
        lines[i] = [(x, m) for x, m in zip(t.split("\n"), masked)]
    leaf = lambda m: (len(m.split()), *m.split()[:depth]) if len(m.split()) >= min_tokens else None
    docs = defaultdict(set)
    for i, ls in lines.items():
        for _, m in ls:
            if m:
                docs[m].add(i)
    by_leaf = defaultdict(list)
    for m in docs:
        if leaf(m):
            by_leaf[leaf(m)].append(m)
    template = {}
    for key, ms in by_leaf.items():
        if len(ms) < 2 or sum(len(docs[m]) for m in ms) < least:
            continue
        n = Counter()
        for m in ms:
            for at, tok in enumerate(m.split()[depth:]):
                n[at, tok] += len(docs[m])
        for m in ms:
            behind = m.split()[depth:]
            need = math.ceil(agree * len(behind) - 1e-9)
            top = sorted((-n[x], *x) for x in enumerate(behind) if n[x] >= least)
            if behind and len(top) >= need:
                template[m] = (key, tuple(x[1:] for x in top[:need]))
    holders = defaultdict(set)
    for m, t in template.items():
        holders[t] |= docs[m]
    general = {m: t for m, t in template.items() if len(holders[t]) >= least}
    common = {m for m in docs if len(docs[m]) >= least} | set(general)
    what = lambda m: general.get(m, m)
    class_of = {}
    for i, ls in lines.items():
        ms = [m for _, m in ls if m]
        class_of[i] = frozenset(Counter(map(what, [m for m in ms if m not in common])).items()) or ("all", frozenset(Counter(map(what, ms)).items()))
    classes = lambda ms: {class_of[i] for m in ms for i in docs[m]}
    keeper = {m: min(docs[m]) for m in common if leaf(m) and len(classes([m])) >= least}
    members = defaultdict(list)
    for m, t in general.items():
        members[t].append(m)
    for ms in members.values():
        if len(classes(ms)) >= least:
            first = min(min(docs[m]) for m in ms)
            for m in ms:
                keeper[m] = min(first, keeper.get(m, first))
    return {i: [x for x, m in ls if keeper.get(m, i) == i] for i, ls in lines.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_templates_as_a_plain_tree(spark, seed):
    """Few openings and words, so that leaves are mixed; numbers, copies of documents, lines twice in a document."""
    rng = random.Random(seed)
    openings = ["Posted by user {n} in", "Seen at the gate", "Seen at the door"]
    tails = [["forum", "news", "today", "please"], ["and", "then", "left", "for", "good"], ["by", "all"]]

    def line():
        opening, tail = rng.choice(openings), [w if rng.random() < 0.75 else rng.choice("abcdefg") for w in rng.choice(tails)]
        return " ".join([opening.format(n=rng.randrange(99)), *tail])

    rows = [(i, "\n".join(rng.choice([line, line, lambda: said(rng)])() for _ in range(rng.randrange(1, 9)))) for i in range(70)]
    rows += [(200 + i, rows[rng.randrange(5)][1]) for i in range(15)]
    rows += [(300 + i, rows[i][1] + "\n" + rows[i][1].split("\n")[0]) for i in range(5)]
    want = plain_templates(rows)
    assert without_lines(spark, rows) == {i: x or [""] for i, x in want.items()} and sum(map(len, want.values())) < sum(len(t.split("\n")) for _, t in rows) * 0.8


def test_sixty_templates_in_exactly_eight_documents(spark):
    rng = random.Random(25)
    templates = [(said(rng, 4), said(rng, 6)) for _ in range(60)]
    rows = [(i, "\n".join(x for a, b in templates for x in (said(rng), f"{a} {said(rng, 1)} {b}", said(rng)))) for i in range(8)]
    out = without_lines(spark, rows)
    assert len(out[0]) == 180 and all(len(out[i]) == 120 for i in range(1, 8))


def test_leaf_of_several_templates(spark):
    rng = random.Random(23)
    ends = ["and then left for the day", "who never asked why it was", "but read all that came after"]
    rows, templated = [], set()
    for i in range(90):
        lines = [f"Seen by one of {said(rng, 1)} {ends[i % 3]}", f"Seen by one of {said(rng, 7)}"]
        templated.add(lines[0])
        rows.append((i, "\n".join([said(rng), *rng.sample(lines, 2), said(rng)])))
    out = without_lines(spark, rows)
    assert {(i, x) for i in out for x in out[i] if x in templated} == {(i, x) for i, t in rows[:3] for x in t.split("\n") if x in templated}
    assert all(x in out[i] for i, t in rows for x in t.split("\n") if x not in templated)


def test_very_long_line(spark):
    """A line of 200,000 tokens beside copies of it that differ at the end, and ordinary ones."""
    rng = random.Random(24)
    long = " ".join(f"t{i % 977}" for i in range(200_000))
    rows = [(i, f"{said(rng)}\n{long} {said(rng, 3)}\n{said(rng)}") for i in range(9)]
    out = without_lines(spark, rows)
    assert len(out[0]) == 3 and all(len(out[i]) == 2 for i in range(1, 9))


# -- tool calls ---------------------------------------------------------------------------------

MESSAGES = "`group` bigint, turn bigint, kind string, call_id string, name string, arguments string, content string, depends_on array<string>"
SCHEMA = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}


def test_tool_calls(spark):
    rows = [
        (1, 5, "call", "c", "add", '{"tags": ["b"], "x": 1.0}', None, ["a", "b"]),
        (1, 6, "call", "a", "add", '{"x": -1, "y": 2}', None, []),
        (1, 9, "result", "a", None, None, "ra", None),
        (1, 2, "call", "b", "add", "{", None, None),
        (1, 1, "result", "b", None, None, "rb", None),
        (1, 3, "result", "zz", None, None, "lost", None),
        (1, 8, "call", "b", "add", '{"x": 3}', None, None),
        (1, 9, "call", "d", "nothing", "{}", None, None),
        (2, 1, "call", "p", "add", '{"x": 1}', None, ["q"]),
        (2, 2, "call", "q", "add", '{"x": 1}', None, ["p"]),
        (None, 1, "call", "a", "add", None, None, None),
        (1, 9, "result", "a", None, None, "ra", None),
    ]
    got = toolcalls.link(frame(spark, rows, MESSAGES), SCHEMA).collect()
    by = {(r["group"], r.call_id, r.status): r for r in got}
    assert len(got) == 9
    assert by[1, "a", "linked"].errors == ["$.x: minimum"] or set(by[1, "a", "linked"].errors) == {"$.y: additional", "$.x: minimum"}
    assert by[1, "b", "linked"].errors == ["$: not JSON"] and by[1, "b", "duplicate"].valid
    assert by[1, "d", "pending"].errors == ["$: unknown tool"] and by[1, "zz", "orphan"].valid is None
    assert by[1, "c", "pending"].valid and by[1, "c", "pending"].record == '{"arguments":{"tags":["b"],"x":1},"call_id":"c","content":null,"group":"1","name":"add","status":"pending"}'
    order = lambda r: (r["at"], r.depth)
    assert order(by[1, "c", "pending"]) > (9, 0) > order(by[1, "a", "linked"]) and not by[1, "c", "pending"].cyclic
    assert by[2, "p", "pending"].cyclic and by[2, "q", "pending"].cyclic
    assert toolcalls.link(spark.createDataFrame([], MESSAGES), SCHEMA).count() == 0


def plain_order(calls, results):
    """Orders by trying again until nothing moves; what never settles is cyclic."""
    done = {}
    for c, t in results:
        done[c] = max(done.get(c, t), t)
    turns = {c: t for c, t, _ in calls}
    needs = {c: {n for n in d or [] if n in turns and n != c} for c, _, d in calls}
    out, left = {}, dict(needs)
    while free := [c for c, n in left.items() if not n - out.keys()]:
        for c in free:
            order = (turns[c], 0)
            for n in left.pop(c):
                at, depth = out[n]
                order = max(order, (done[n], 1) if done.get(n, at) > at else (at, depth + 2))
            out[c] = order
    return {c: (*out.get(c, (turns[c], 0)), c not in out) for c in turns}


def ordering(spark, calls, results, **options):
    c = spark.createDataFrame([(1, *x) for x in calls], "`group` bigint, call_id string, turn bigint, depends_on array<string>")
    r = spark.createDataFrame([(1, *x) for x in results], "`group` bigint, call_id string, turn bigint")
    return {x["call_id"]: (x["at"], x["depth"], x["cyclic"]) for x in toolcalls.in_order(c, r, **options).collect()}


def test_order_of_calls(spark):
    rng = random.Random(5)
    for size in (1, 6, 30):
        calls = [(f"c{i}", rng.randrange(40), [f"c{rng.randrange(size + 2)}" for _ in range(rng.randrange(3))]) for i in range(size)]
        results = [(f"c{rng.randrange(size)}", rng.randrange(60)) for _ in range(size)]
        expected = plain_order(calls, results)
        assert ordering(spark, calls, results) == expected
        if size < 10:
            assert ordering(spark, calls, results, group_calls=0) == expected


@pytest.mark.parametrize("forward, cycle", [(True, False), (False, False), (True, True)])
def test_order_of_a_long_chain_takes_no_rounds(spark, monkeypatch, forward, cycle):
    n = 10_000
    need = lambda i: (i + 1) % n if forward else i - 1
    monkeypatch.setattr(toolcalls, "relaxed", None)  # rounds of joins are for larger groups
    calls = [(f"c{i}", i, [f"c{need(i)}"] if cycle or 0 <= i + (1 if forward else -1) < n else None) for i in range(n)]
    got = ordering(spark, calls, [])
    if cycle:
        assert got == {f"c{i}": (i, 0, True) for i in range(n)}
    elif forward:  # each call behind the next one
        assert got == {f"c{i}": (n - 1, 2 * (n - 1 - i), False) for i in range(n)}
    else:
        assert got == {f"c{i}": (i, 0, False) for i in range(n)}


@pytest.mark.parametrize(
    "text, problem",
    [('{"turn": 1e999}', "$: number out of range"), ("9" * 5000, "$: number out of range"), ("[" * 200_000, "$: nested too deeply"), ("[" * 201 + "]" * 201, "$: nested too deeply"), ("[" * 300, "$: nested too deeply"), ("NaN", "$: not JSON"), (None, "$: not JSON"), ('{"x": true}', "$.x: enum"), ('{"y": 1}', "$.y: const")],
)
def test_arguments_beyond_the_limits(text, problem):
    schema = {"properties": {"x": {"enum": [1, "a"]}, "y": {"const": True}}}
    value, found = toolcalls.checked(text, schema)
    assert found == [problem]
    toolcalls.canonical(value)


def test_odd_arguments_are_read():
    assert toolcalls.checked("9" * 400, {"type": "integer"})[1] == []
    value, found = toolcalls.checked('{"\\ud800": "\\udfff"}', {"additionalProperties": False})
    assert found == ["$.\\ud800: additional"] and toolcalls.canonical(value) == '{"\\ud800":"\\udfff"}'
    toolcalls.canonical(value).encode()
    assert toolcalls.checked('{"x": "' + "[" * 500 + '"}', {"type": "object"})[1] == []


def test_tool_calls_with_clashing_columns_and_long_texts(spark):
    rows = [(1, 1, "call", "a", "add", '{"x": 1, "tags": ["' + "t" * 3_000_000 + '"]}', None, None, "own", 7), (1, 2, "result", "a", None, None, "r" * 3_000_000, None, "own", 7)]
    messages = spark.createDataFrame(rows, MESSAGES + ", record string, at bigint")
    got = toolcalls.link(messages, SCHEMA).collect()
    assert [(r["status"], r["valid"], r["at"]) for r in got] == [("linked", True, 1)] and len(got[0]["record"]) > 6_000_000


def test_conversations_become_calls(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", None), (2, 0, "assistant", "first"), (None, 0, "user", "x"), (3, None, "user", "y"), (4, 0, None, "z")]
    got = toolcalls.digest(toolcalls.link(toolcalls.from_conversations(frame(spark, rows, "conv_id bigint, turn bigint, role string, text string")), {"answer": toolcalls.ANSWER})).collect()
    states = sorted((str(r.conv_id), str(r.call_turn), r.status, r.valid) for r in got)
    assert ("1", "1", "linked", True) in states and ("1", "3", "pending", False) in states and ("2", "None", "orphan", None) in states


def test_canonical_json():
    assert toolcalls.canonical({"b": [1.0, True, None, "é\n"], "a": 1.5}) == '{"a":1.5,"b":[1,true,null,"é\\n"]}'
    with pytest.raises(ValueError):
        toolcalls.canonical(float("nan"))
