import hashlib
import tarfile
import zlib

from pyarrow import fs

from ledgerline.llm import media
from ledgerline.workdir import new_path

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "ñ€🙂", "a", "long " * 40000]


def padded(t):
    raw = (t or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_round_trip_headers_and_members(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, width int").coalesce(1)
    index = media.store(docs, new_path(spark, "media-test"))
    got = {r.doc_id: r for r in media.features(index).collect()}
    heads = {r.doc_id: r for r in media.metadata(index).collect()}
    for i, t in enumerate(TEXTS):
        p = padded(t)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(p))
        assert r.payload_sha256 == heads[i].digest == hashlib.sha256(p).hexdigest()
        assert r.tail_crc32 == zlib.crc32(p[-64:])
        assert (heads[i].width, heads[i].height, heads[i].bits) == (64, len(p) // 64, 8)
        member = media.to_png(p)
        assert (r.media_bytes, r.media_sha256, r.length) == (len(member), hashlib.sha256(member).hexdigest(), len(member))
        levels = [p.count(bytes([v])) for v in range(256)]
        assert r.feature == f"64x{len(p) // 64}x8:sum={sum(p)}:levels={sum(n > 0 for n in levels)}:mode={levels.index(max(levels))}"
    assert heads[2].offset == heads[6].offset and heads[0].offset == heads[1].offset
    files, path = fs.FileSystem.from_uri(heads[0].shard)
    with files.open_input_file(path) as f, tarfile.open(fileobj=f) as tar:
        names = tar.getnames()
        assert sorted(names) == sorted({f"{r.digest}.png" for r in heads.values()})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert media.features(media.store(docs, new_path(spark, "media-test"))).count() == 0


def test_equal_texts_share_a_place_across_shards(spark):
    rows = [(None, "one"), (7, "one"), (7, "two"), (8, "one"), (9, None), (10, ""), (11, "two")] * 3
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, digest int, place int").repartition(5)
    got = media.features(media.metadata(media.store(docs, new_path(spark, "media-test")))).collect()
    assert len(got) == len(rows)
    places = {}
    for r in got:
        places.setdefault(r.digest, set()).add(tuple(v for c, v in r.asDict().items() if c != "doc_id"))
    assert len(places) == 3 and all(len(p) == 1 for p in places.values())
