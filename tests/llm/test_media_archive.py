import hashlib
import zlib

import pytest

from tidelog.llm.media_archive import MediaArchiveReader, decode_png, encode_png, feature, media_columns, payload_of, read_archives, write_archives


def check(docs, rows):
    want = []
    for d in docs.collect():
        data = (d.text or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        want.append((d.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)


def test_round_trip_of_all_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = write_archives(docs, str(tmp_path / "a"))
    assert n == docs.count()
    members = read_archives(spark, str(tmp_path / "a"), rangebytes=50_000)
    assert members.rdd.getNumPartitions() > 3
    rows = media_columns(members).collect()
    check(docs, rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.payload_sha256, tuple(r)[2:]) == tuple(r)[2:]


def test_odd_rows(spark, tmp_path):
    texts = [None, "", "é" * 288, "x" * 577, "word " * 50_000, "same", "same"]
    docs = spark.createDataFrame([(None if i == 3 else i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    write_archives(docs, f"file://{tmp_path}/b")
    check(docs, media_columns(read_archives(spark, f"file://{tmp_path}/b")).collect())
    assert write_archives(docs.limit(0), str(tmp_path / "c")) == 0
    assert media_columns(read_archives(spark, str(tmp_path / "c"))).count() == 0


def test_one_damaged_member_leaves_the_others(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(20)], "doc_id long, text string").coalesce(1)
    write_archives(docs, str(tmp_path / "d"))
    archive = next((tmp_path / "d").glob("*.zip"))
    rows = read_archives(spark, str(tmp_path / "d"), tries=2).orderBy("offset").collect()
    data = bytearray(archive.read_bytes())
    data[rows[7].offset + 80] ^= 1
    archive.write_bytes(data)
    after = read_archives(spark, str(tmp_path / "d"), tries=2).orderBy("offset").collect()
    assert [r.name for r in after if r.error] == [rows[7].name] and len(after) == 20
    assert [r.media for i, r in enumerate(after) if i != 7] == [bytearray(r.media) for i, r in enumerate(rows) if i != 7]


def test_a_member_is_tried_again(tmp_path):
    reader, calls = MediaArchiveReader({"path": str(tmp_path)}), []
    (tmp_path / "f").write_bytes(b"x")

    def flaky(f):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost")
        return b"ok"

    assert reader._retry(str(tmp_path / "f"), flaky) == (b"ok", None) and len(calls) == 3


@pytest.mark.parametrize("data", [b"", b"a", bytes(range(255)) * 9])
def test_png(data):
    payload = payload_of(data)
    assert len(payload) % 576 == 0 and payload
    assert decode_png(encode_png(payload)) == payload
    assert feature(payload) == feature(bytes(payload))
    with pytest.raises((ValueError, zlib.error)):
        decode_png(encode_png(payload)[:-20] + b"y" * 20)


def test_what_is_stored_by_other_readers(spark, tmp_path, monkeypatch):
    """Stored sizes, digests and features against the archives as the standard library reads them."""
    import hashlib
    import math
    import zipfile
    import zlib
    from collections import Counter

    from tidelog.llm import media_archive as M

    texts = [(i, t) for i, t in enumerate([None, "", "a", "é" * 700, "x" * 576, "word " * 9000, "same", "same"])]
    M.write_archives(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), str(tmp_path / "a"))
    got = {r.doc_id: r for r in M.media_columns(M.read_archives(spark, str(tmp_path / "a"))).collect()}
    assert len(got) == len(texts)
    seen = 0
    for archive in (tmp_path / "a").glob("*.zip"):
        with zipfile.ZipFile(archive) as z:
            assert z.testzip() is None
            for name in z.namelist():
                media, r = z.read(name), got[int(name.partition("_")[2])]
                seen += 1
                assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
                body = media[media.index(b"IDAT") + 4 : media.rindex(b"IEND") - 8]
                lines = zlib.decompress(body)
                payload = b"".join(lines[k + 1 : k + 577] for k in range(0, len(lines), 577))
                data = (dict(texts)[r.doc_id] or "").encode()
                assert payload.startswith(data) and set(payload[len(data) :]) <= {255} and len(payload) % 576 == 0
                n, count = len(payload), Counter(payload)
                mean = sum(payload) / n
                std = math.sqrt(max(0, sum(c * b * b for b, c in count.items()) / n - mean * mean))
                entropy = -sum(c / n * math.log2(c / n) for c in count.values())
                levels = "/".join(str(sum(c for b, c in count.items() if b // 32 == k) * 1000 // n) for k in range(8))
                assert r.feature == f"mean={mean:.3f};std={std:.3f};entropy={entropy + 0.0:.3f};levels={levels}"
    assert seen == len(texts)
    # archives of very many members have a wide end record
    monkeypatch.setattr(M, "ARCHIVE_MEMBERS", 70_000)
    writer = M._ArchiveWriter(str(tmp_path))
    for i in range(66_000):
        writer.add(f"{i:07d}_{i}", b"m")
    writer.close()
    path = writer.done[0][0]
    files, place = M._open(path)
    with files.open_input_file(place) as f:
        every = M.archive_directory(f)
        assert len(every) == 66_000 and M.read_member(f, every[65_999][1]) == b"m"
        assert len(M.archive_directory(f, every[100][1], every[200][1])) == 100
    with zipfile.ZipFile(place) as z:
        assert len(z.namelist()) == 66_000
