"""Pieces, personal data, toxicity, pages, fingerprints, mixing, the registered queries and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from convspan.llm import fingerprints, mixing, neardup, pieces, pii, registry, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path())


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(open(registry.tokenizer_path(), "rb").read())


def test_pieces_like_the_library(model, library):
    rng = random.Random(4)
    parts = ["a", "b", " ", "  ", "the", "ing", "\n", "\t", "é", "😀", "▁", "!", "1", "漢", "​", "\x01", "<s>", "<0x0A>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["", " ", "a" * 3000, " " * 300]
    offsets, ids, ends = model.encode_all(texts)
    decoded = model.decode_all(offsets, ids).to_pylist()
    for k, text in enumerate(texts):
        own, own_ends = ids[offsets[k] : offsets[k + 1]].tolist(), ends[offsets[k] : offsets[k + 1]]
        assert own == library.encode(text) and decoded[k] == library.decode(own) == model.decode(own)
        if own:
            assert own_ends[-1] == len(text.encode()) and (np.diff(own_ends) >= 0).all()
        if "▁" not in text:  # every span is the piece's own bytes
            starts = np.append(0, own_ends[:-1])
            joined = b"".join(text.encode()[a:b] for a, b in zip(starts, own_ends))
            assert joined == text.encode()


def test_character_map_like_the_library():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model = pieces.PieceModel(normalizer.serialized_model_proto())
    for text in ("ﬁ ½ Å  Ａｂｃ　x", "  a ", "㍿ é é", "", " ", "​q\tz", "①②  ③", "x" * 50):
        norm, ends = model.normalize(text)
        assert norm == normalizer.normalize(text)
        assert len(ends) == len(norm) and all(a <= b for a, b in zip(ends, ends[1:])) and (not ends or ends[-1] <= len(text.encode()))


def test_piece_table(docs, empty, library):
    odd = docs.withColumn("ids", F.lit(1))
    got = pieces.encode_documents(odd, registry.tokenizer_path()).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert pieces.encode_documents(empty, registry.tokenizer_path()).count() == 0


def plain_base(text):
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_base_patterns():
    rng = random.Random(8)
    parts = ["a@b.co", "x", "@", ".", "..", "1", "255", "256", "4111 1111 1111 1111", "+1 (974) 555-3436", "-", " ", "+", "joe.", "é", "\n", "1.2.3.4.5", "a@b@c.de", "00", "(5)"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("1" * 200_000 + "a" * 200_000) == []


def test_field_and_mask(spark, docs, empty):
    text = "call +1 (974) 555-3436 now. later again: 974 555-3436 and +1 (974) 555-3436 190.1.2.3 key = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    field = pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    frame = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(frame, field).withColumn("masked", pii.mask()).collect()}
    spans = [(s.kind, text[s.start : s.end]) for s in got[1].spans]
    assert ("phone", "+1 (974) 555-3436") in spans and any(k == "key" for k, _ in spans) and set(map(tuple, got[1].base)) <= set(map(tuple, got[1].spans))
    assert "[PHONE]" in got[1].masked and "04dbebab" not in got[1].masked and got[1].masked.startswith("call ")
    assert got[2].masked == "nothing here" and got[2].spans == [] and got[3].spans == []
    assert pii.find_personal_data(docs.withColumn("spans", F.lit(0)), field).count() == docs.count() and pii.find_personal_data(empty, pii.fit(empty)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_documents(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out())
    tp, fp, fn = scored.selectExpr("count_if(predicted = 1 and toxic = 1)", "count_if(predicted = 1 and toxic = 0)", "count_if(predicted = 0 and toxic = 1)").first()
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.8


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (0, 0)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for known in (labels, none):
        scores = [r.score for r in toxicity.score_documents(docs.withColumn("score", F.lit("x")), toxicity.fit(docs, known)).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.score_documents(empty, toxicity.fit(empty, none)).count() == 0


def test_fingerprints(spark, real):
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_edits(real).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in real.collect())
    off = []
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[doc].n_chars == len(text) and got[doc].edited_sha256 == sha(edited)
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = collections.Counter(WORD.findall(text)), collections.Counter(WORD.findall(other))
            off.append(getattr(got[doc], name) - sum((a & b).values()) / max(1, sum((a | b).values())))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.1


def test_fingerprint_edges(docs, empty):
    got = fingerprints.fingerprint_with_edits(docs.withColumn("place", F.lit(1))).collect()
    assert len(got) == docs.count()
    by_text = collections.defaultdict(set)
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None:
            by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and by_text[""] == {""}
    assert fingerprints.fingerprint_with_edits(empty).count() == 0


def plain_targets(sizes, cap=3):
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    free, left, target = set(sizes), sum(sizes.values()), {}
    while free:
        share = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / share for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def check_mix(frame, rows):
    sizes = collections.Counter()
    for source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target, taken = plain_targets(sizes), collections.Counter()
    for r in frame.collect():
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) <= 1e-6 * max(1, r.target) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_mixing(spark, docs, empty, real):
    for frame in (docs, real):
        rows = [(r.source, r.text) for r in frame.collect()]
        check_mix(mixing.mix_sources(frame), rows)
        again = lambda: sorted(map(tuple, mixing.mix_sources(frame).collect()), key=repr)
        assert again() == again()
    assert mixing.mix_sources(empty).count() == 0
    rows = [(k, "w " * n, s) for k, (s, n) in enumerate([("a", 1000), ("b", 3), ("c", 10), (None, 0), ("d", 700), ("", 5)])]
    check_mix(mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")), [(s, t) for _, t, s in rows])


def test_registered_queries(spark):
    found = registry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 11))
    from compare import database, rows

    for name, sql in registry.oracle_sql().items():
        assert rows(found[name](spark, SF).toPandas()) == rows(database(SF).sql(sql).df())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        ids = [r.doc_id for r in after]
        assert after and set(ids) <= set(before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near duplicates":
            from test_repeats import plain_components

            assert sorted(ids) == sorted({d for d, _, _, kept in plain_components([(d, r.text) for d, r in before.items()]) if kept})
        if name == "personal data":
            assert len(after) == len(before) and all(not plain_base(r.text) for r in after)
        if name == "mixing":
            assert collections.Counter(ids).most_common(1)[0][1] <= 3
            words = collections.Counter()
            for r in after:
                words[r.source] += len(WORD.findall(r.text))
            sizes = collections.Counter()
            for r in before.values():
                sizes[r.source] += len(WORD.findall(r.text))
            target, most = plain_targets(sizes), max(len(WORD.findall(r.text)) for r in before.values())
            assert all(abs(words[s] - target[s]) <= most for s in sizes)
        if name == "pieces":
            library = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path())
            for r in after:
                assert r.ids_sha256 == sha(",".join(map(str, library.encode(before[r.doc_id].text))))


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_with_odd_rows(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


ODD = ("at", "copies", "rows", "copy", "n_shingles", "component_id", "kept", "predicted", "score", "base", "spans", "row_key_1", "row_key_2", "size", "taken", "slice", "named", "order", "k1", "bands", "rep", "u")


def test_pipeline_stages_with_clashing_columns(spark, docs):
    """Every stage but the last returns further columns, whatever their names, as they were, and decides as without them."""
    marked = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ODD})
    for name, stage in corpus_pipeline.STAGES:
        plain, got = row_counts(stage(spark, docs, SF)), stage(spark, marked, SF)
        if name == "pieces":
            assert row_counts(got) == plain
            continue
        assert got.columns == marked.columns
        assert row_counts(got.select(*docs.columns)) == plain
        assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in got.collect() for c in ODD)


def test_stages_agree_on_reruns(spark, real):
    for _, stage in corpus_pipeline.STAGES:
        assert row_counts(stage(spark, real, SF)) == row_counts(stage(spark, real.repartition(3), SF))


def test_a_cluster_has_to_name_its_folder(monkeypatch):
    from convspan.llm import common

    class Context:
        master = "spark://somewhere"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    with pytest.raises(ValueError):
        common.shared_folder(type("Session", (), {"sparkContext": Context}))


def row_counts(frame):
    return collections.Counter(map(tuple, frame.collect()))


def test_pipeline_keeps_rows_of_one_id_apart(spark):
    """Null ids and one id with several texts, in the mix and among near duplicates, against plain versions."""
    from test_repeats import plain_components

    text = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(None, text("a", 40), "en", "one", 1), (None, "", "en", "one", 2), (None, text("b", 40), "en", "two", 3), (None, text("b", 40), "en", None, 3), (None, None, None, None, None), (5, text("c", 60), "en", "one", 4)]
    rows += [(5, text("d", 60), "en", "two", 5), (5, text("d", 60), "en", "two", 5), (3, text("c", 59), "en", "three", 6), (9, text("d", 61), "en", "one", 7), (7, text("e", 30), "en", "three", 8), (7, " ", "en", "two", 9)]
    rows += [(8, text("f", 50), "en", "one", 10), (8, text("f", 51), "en", "one", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    kept = row_counts(corpus_pipeline.drop_near_duplicates(spark, docs, SF))
    named = plain_components([(k, r[1]) for k, r in enumerate(rows) if r[0] is not None])
    groups = collections.defaultdict(list)
    for place, size, component, _ in named:
        if size:
            groups[component].append(rows[place])
    alone = [r for r in rows if r[0] is None or not (r[1] or "").strip()]
    assert sum(kept.values()) == len(alone) + len(groups) and all(kept[r] == n for r, n in collections.Counter(alone).items())
    for members in groups.values():
        (one,) = [r for r in set(members) if kept[r]]
        assert one[0] == min(m[0] for m in members) and kept[one] == 1
    assert {(r.doc_id, r.component_id) for r in neardup.find_components(docs).collect() if r.doc_id == 5} == {(5, 3), (5, 5)}

    mixed = row_counts(corpus_pipeline.mix_to_weights(spark, docs, SF))
    assert mixed == row_counts(corpus_pipeline.mix_to_weights(spark, docs.repartition(5), SF))
    copies = collections.Counter()
    for r in mixing.mix_sources(docs.withColumn("place", F.xxhash64("text", "source", "doc_id")), keys=("place",)).collect():
        copies[r.doc_id, r.source, r.size] += r.copies
    wanted = collections.Counter()
    for r, n in mixed.items():
        wanted[r[0], r[3], len((r[1] or "").split())] += n
    assert +copies == +wanted



def test_votes_against_plain_words(real):
    """Voters and votes by dictionaries of plain words; scores from them."""
    texts = [r.text or "" for r in real.collect()] + ["", "Idiot idiot IDIOT", "Été x", "a1b2", "word " * 50_000]
    import pyarrow as pa

    from convspan.llm.textarrays import byte_sums

    name = lambda x, n=0: int((byte_sums(np.frombuffer(x, np.uint8)).slices(np.array([0]), np.array([len(x)])) ^ np.uint64(n)).view(np.int64)[0])

    def plain(text):
        found = set()
        for word in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()):
            found.add(name(word))
            found |= {name(word[:n], n) for n in toxicity.BEGINNINGS if len(word) > n}
        return found

    held = [plain(x) for x in texts]
    counts = collections.Counter(f for x in held for f in x)
    voters = np.sort(np.array([f for f, _ in counts.most_common(60)] + [1, 2], np.int64))
    model = toxicity.Model(voters, np.linspace(-1, 1, len(voters) + len(toxicity.SEVERAL)), -0.3)
    votes = model.votes(pa.array(texts))
    for row, own in zip(votes, held, strict=True):
        want = [v in own for v in voters.tolist()]
        assert row.tolist() == want + [sum(want) >= n for n in toxicity.SEVERAL]
    assert np.allclose(model.scores(pa.array(texts)), 1 / (1 + np.exp(-(votes @ model.weights + model.bias))))


def test_mined_voters_against_plain_counts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    sample = toxicity._labelled(docs, labels, toxicity.LABELLED)
    got = toxicity._mine(sample)
    import pyarrow as pa

    rows = [(r.text, r.toxic) for r in sample.collect()]
    held, hit = collections.Counter(), collections.Counter()
    for text, toxic in rows:
        for f in {int(f) for _, _, _, found in toxicity._features(pa.array([text])) for f in found}:
            held[f] += 1
            hit[f] += toxic
    share = sum(t for _, t in rows) / len(rows)
    excess = {f: (hit[f] - n * share) / (n * share) ** 0.5 for f, n in held.items() if hit[f] >= toxicity.LEAST_ROWS and hit[f] * (1 - share) >= toxicity.LEAST_LIFT * share * (n - hit[f])}
    want = sorted(excess, key=lambda f: (-excess[f], f))[: toxicity.VOTERS]
    assert len(want) > 10 and len(set(want) ^ set(got.tolist())) <= 2  # ties of the excess may round either way


def test_labels_agree_with_the_model_where_voters_are_sound():
    """The label model finds mislabelled rows when voters have known, independent rates."""
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.2
    votes = np.stack([np.where(truth, rng.random(4000) < 0.7, rng.random(4000) < 0.05) for _ in range(12)], axis=1)
    label = truth ^ (rng.random(4000) < 0.05)
    posterior = toxicity._label_model(votes, label)
    assert ((posterior > 0.5) != truth).mean() < 0.01 < (label != truth).mean()


def test_samples_against_a_plain_sampler(spark):
    """Likenesses from fingerprints equal those of a sampler that keeps each sample's word and grid place."""
    import math

    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(w,) for w in words], "word string").withColumn("h", F.xxhash64("word"))
    seeds = {r.word: (r.x, r.y) for r in known.select("word", F.array(*[F.xxhash64("h", F.lit(k)) for k in range(fingerprints.SAMPLES)]).alias("x"), F.array(*[F.xxhash64("h", F.lit(-1 - k)) for k in range(fingerprints.SAMPLES)]).alias("y")).collect()}

    def sample(text, k):
        best = []
        for word, n in collections.Counter(text.split()).items():
            x, y = (v[k] & (1 << 64) - 1 for v in seeds[word])
            r = -math.log(((x >> 42) + 0.5) * ((x >> 21 & (1 << 21) - 1) + 0.5) * 2.0**-43)
            b = ((x & (1 << 21) - 1) + 0.5) * 2.0**-21
            c = -math.log(((y >> 32) + 0.5) * ((y & (1 << 32) - 1) + 0.5) * 2.0**-64)
            place = math.floor(math.log(n) / r + b)
            best.append((math.log(c) - r * (place - b + 1), word, place))
        return min(best)[1:]

    plain = [[sample(t, k) for k in range(fingerprints.SAMPLES)] for _, t in rows]
    got = {r.doc_id: r.near_next for r in fingerprints.fingerprint_with_edits(frame).collect()}
    for k in range(30):
        want = sum(a == b for a, b in zip(plain[k], plain[(k + 1) % 30])) / fingerprints.SAMPLES
        assert abs(got[k] - want) < 0.03
    assert sum(abs(got[k] - sum(a == b for a, b in zip(plain[k], plain[(k + 1) % 30])) / fingerprints.SAMPLES) < 1e-9 for k in range(30)) >= 28


def test_very_long_texts(spark):
    """A text of a few MB beside short ones, for the operators that work text by text."""
    long = "some words that go on " * 150_000
    frame = spark.createDataFrame([(1, long), (2, "short"), (3, long), (None, long)], "doc_id long, text string").withColumn("source", F.lit("a"))
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_edits(frame).collect()}
    assert got[1].fingerprint == got[3].fingerprint == got[None].fingerprint and got[1].n_chars == len(long)
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(len(toxicity.SEVERAL)), 0.0)
    assert [r.score for r in toxicity.score_documents(frame, model).collect()] == [0.5] * 4
    assert {r.size for r in mixing.mix_sources(frame).collect()} == {750_000, 1}
