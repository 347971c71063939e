import random

import pytest

from quillspark.llm import shared
from quillspark.llm.warc import digest, member, read, record, round_trip, salvage, write


def archive(n=20, squeeze=True):
    r = random.Random(1)
    parts = []
    for i in range(n):
        x = record(i, f"http://h/{i}", bytes(r.randrange(256) for _ in range(r.randrange(400))), None if i % 4 else 99)
        parts.append(member(x) if squeeze else x)
    return parts


@pytest.mark.parametrize("squeeze", [True, False])
def test_salvage_recovers_what_is_whole(squeeze):
    parts = archive(squeeze=squeeze)
    whole = b"".join(parts)
    records, gaps = salvage(whole)
    assert [int(x.headers["x-page-id"]) for x in records] == list(range(20)) and not gaps
    r = random.Random(2)
    for _ in range(150):
        hurt = r.randrange(20)
        kind = r.choice(["flip", "cut", "junk", "drop"])
        part = bytearray(parts[hurt])
        if kind == "flip":
            at = r.randrange(len(part))
            part[at] ^= 1 << r.randrange(8)
        elif kind == "cut":
            del part[r.randrange(len(part)) :]
        elif kind == "drop":
            at = r.randrange(len(part))
            del part[at : at + r.randint(1, 30)]
        else:
            part[r.randrange(len(part)) : 0] = b"\x1f\x8b\x08WARC/1.1\r\njunk"
        data = b"".join([*parts[:hurt], bytes(part), *parts[hurt + 1 :]])
        records, gaps = salvage(data)
        ids = [int(x.headers["x-page-id"]) for x in records if x.headers.get("x-page-id", "").isdigit()]
        assert set(range(20)) - {hurt, hurt + 1} <= set(ids)
        if hurt not in ids:
            assert gaps or kind == "cut" or not squeeze  # plain headers have no checksum
        assert all(0 <= g.start < g.end <= len(data) for g in gaps)
    assert salvage(b"") == ([], []) and salvage(b"nothing here")[1][0][:2] == (0, 12)


def test_salvage_inside_members():
    plain = archive(5, squeeze=False)
    hurt = bytearray(plain[2])
    hurt[-10] ^= 255
    ids = lambda records: [int(x.headers["x-page-id"]) for x in records]
    # the third of five records in one member fails its digest
    data = member(b"".join([*plain[:2], bytes(hurt), *plain[3:]]))
    records, gaps = salvage(data)
    assert ids(records) == [0, 1, 3, 4] and [(g.start, g.end) for g in gaps] == [(0, len(data))] and "digest" in gaps[0].reason
    # a member cut before its end keeps what was inflated; the next member is read
    whole, after = member(b"".join(plain)), member(record(9, "u", b"x", None))
    for cut, kept in ((8, 5), (10, 4), (300, 3)):
        records, gaps = salvage(whole[:-cut] + after)
        assert set(ids(records)) >= {*range(kept), 9} and [(g.start, g.end) for g in gaps] == [(0, len(whole) - cut)]
        records, gaps = salvage(whole[:-cut])
        assert set(ids(records)) >= set(range(kept)) and len(gaps) == 1
    # damage in the middle of the compressed bytes
    broken = bytearray(whole)
    broken[len(whole) * 3 // 4] ^= 255
    records, gaps = salvage(bytes(broken) + after)
    assert ids(records)[:2] == [0, 1] and ids(records)[-1] == 9 and gaps


def test_damage_is_an_error_when_archives_are_whole(spark):
    from pathlib import Path

    from quillspark.llm.warc import read_listed

    folder = shared.folder(spark, "warc-listed")
    manifest = write(spark.createDataFrame([(i, "u", f"text {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1), folder)
    # an archive of an attempt that lost isn't listed
    (path,) = Path(folder.removeprefix("file:")).glob("*.warc.gz")
    path.with_name("pages-000000-99-0000.warc.gz").write_bytes(path.read_bytes())
    assert read_listed(manifest, folder).count() == 40
    data = path.read_bytes()
    path.write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="is damaged"):
        read_listed(manifest, folder).count()
    assert read_listed(manifest, folder, whole=False).where("kind = 'gap'").count() == 1


def test_round_trip(spark):
    pages = [(i, f"http://x/{i % 7}\r\nEvil: 1", f"page {i % 11} é") for i in range(60)] + [(60, None, None), (61, "u", ""), (62, "u", "alone"), (None, "u", "page 3 é"), (70, "u", "b" * 300000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, winner string").repartition(3)
    got = sorted(round_trip(df).collect(), key=lambda x: (x.page_id is None, x.page_id))
    assert len(got) == len(pages)
    last = {}
    for i, _, h in pages:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    for x, (i, _, h) in zip(got, sorted(pages, key=lambda p: (p[0] is None, p[0])), strict=True):
        h = h or ""
        revisit = last[h] != i
        assert tuple(x) == (i, len(h.encode()), digest(h.encode()), "revisit" if revisit else "response", last[h] if revisit else None)
    assert round_trip(df.limit(0)).count() == 0


def test_damaged_archives_leave_gaps(spark):
    folder = shared.folder(spark, "warc-test").removeprefix("file:")
    write(spark.createDataFrame([(i, "u", f"text {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1), folder)
    from pathlib import Path

    (path,) = Path(folder).glob("*.warc.gz")
    data = bytearray(path.read_bytes())
    for at in range(len(data) // 2, len(data) // 2 + 12):
        data[at] ^= 255
    path.write_bytes(bytes(data))
    for crc in Path(folder).glob(".*.crc"):
        crc.unlink()
    found = read(spark, folder)
    kinds = {r.kind: r.n for r in found.groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    lost = 40 - kinds["record"]
    assert kinds == {"record": 40 - lost, "gap": 1} and lost in (1, 2)
    assert found.where("kind = 'record'").where("payload is null").count() == 0
