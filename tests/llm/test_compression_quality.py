import random
import zlib

import zstandard

from tidelog.llm.compression_quality import SMOOTHING, held_out, keep_good, score, train


def test_held_out_accuracy_and_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    rows = {r.doc_id: r for r in score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    sides = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=model.level, write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for i in list(texts)[:100]:
        good, bad = (len(s.compress(texts[i].encode())) for s in sides)
        x = model.slope * (bad - good) / (bad + good + SMOOTHING) + model.bias
        assert abs(rows[i].score - 1 / (1 + 2.718281828459045 ** -x)) < 0.02
        assert rows[i].predicted == int(rows[i].score >= 0.3)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())
    known = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(r.predicted == q for r, q in known) / len(known) > 0.9
    kept = {r.doc_id for r in keep_good(docs, model).select("doc_id").collect()}
    assert kept == {i for i, r in rows.items() if r.predicted}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (2, "", 1.0), (None, "word " * 40000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    model = train(docs, labels)
    assert [r.score for r in score(docs, model).collect()] == [0.5] * 4
    assert keep_good(docs, model).count() == 4
    assert score(docs.limit(0), model).count() == 0
    assert docs.where("doc_id is null").select(held_out().alias("h")).first().h is False


def test_scores_are_calibrated_and_whole_texts_teach(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), train(docs, labels)).where("held_out").collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    pairs = [(r.score, quality[r.doc_id]) for r in rows]
    base = sum(q for _, q in pairs) / len(pairs)
    assert abs(sum(s for s, _ in pairs) / len(pairs) - base) < 0.03
    bins = [[p for p in pairs if lo / 5 <= p[0] < lo / 5 + 0.2 + 1e-9] for lo in range(5)]
    error = sum(abs(sum(s - q for s, q in b)) for b in bins) / len(pairs)
    assert error < 0.05

    # what tells the classes apart stands at the ends of long texts only
    r = random.Random(4)
    vocabulary = [["".join(r.choice("abcdefghijklmnopqrst") for _ in range(8)) for _ in range(300)] for _ in range(2)]
    texts = [(i, "filler of both kinds " * 1100 + " ".join(r.choice(vocabulary[i % 2]) for _ in range(700))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = score(docs, train(docs, labels)).where("held_out").collect()
    assert len(got) > 5 and all(r.predicted == r.doc_id % 2 for r in got)
