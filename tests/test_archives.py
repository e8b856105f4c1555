"""Members of tar archives read by splits, against the standard library."""

import io
import json
import tarfile

import pytest

from terralex.sources import archives, concordance


def feature(i, fill=0, name="x"):
    return json.dumps({"type": "Feature", "geometry": {"ring": "}{" * fill}, "properties": {"wof:id": i, "wof:placetype": "locality", "n": name, "wof:concordances": {"gn:id": 100 + i}}}).encode()


def write(path, members):
    with tarfile.open(path, "w", format=tarfile.USTAR_FORMAT) as out:
        for name, data, kind in members:
            info = tarfile.TarInfo(name)
            info.size, info.type = len(data), kind
            out.addfile(info, io.BytesIO(data))


def nested():
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as out:
        for i in range(40):
            info = tarfile.TarInfo(f"inner/{i}.geojson")
            info.size = len(feature(i, 100))
            out.addfile(info, io.BytesIO(feature(i, 100)))
    return inner.getvalue()


MEMBERS = [
    *[(f"data/{i:03d}.geojson", feature(i, i * 7 % 400), tarfile.REGTYPE) for i in range(120)],
    ("data/huge.GeoJSON", feature(900, 30000), tarfile.REGTYPE),  # longer than several splits
    ("meta.csv", b"a,b\n" * 3000, tarfile.REGTYPE), ("data", b"", tarfile.DIRTYPE), ("empty.geojson", b"", tarfile.REGTYPE),
    ("archive.tar", nested(), tarfile.REGTYPE),  # its headers are data here
    ("none.geojson", b'{"properties": 3}', tarfile.REGTYPE), ("cut.geojson", b'{"properties": {"a": "}"', tarfile.REGTYPE),
    ("bytes.geojson", b'{"properties": {"a": "\xff"}}', tarfile.REGTYPE), ("p/" * 60 + "long.geojson", feature(5), tarfile.REGTYPE),
    ("exact.geojson", feature(7).ljust(1024), tarfile.REGTYPE), ("text.geojson", json.dumps({"properties": {"a\\\"{": "}\"{", "é": [{"}": 1}]}}, ensure_ascii=False).encode(), tarfile.REGTYPE),
]


@pytest.mark.parametrize("split", [1 << 12, 10240, 1 << 20])
def test_members(spark, tmp_path, split):
    path = tmp_path / "a.tar"
    write(path, MEMBERS)
    got = sorted(((r["path"], r["properties"]) for r in archives.archive_members(spark, f"file://{path}", split).collect()), key=str)
    want = []
    for name, data, kind in MEMBERS:
        if kind == tarfile.REGTYPE and name.lower().endswith(".geojson"):
            try:
                properties = json.loads(data.decode())["properties"]
                want.append((name, properties if isinstance(properties, dict) else None))
            except (ValueError, KeyError):
                want.append((name, None))
    assert [(n, p and json.loads(p)) for n, p in got] == sorted(want, key=lambda x: next(str(g) for g in got if g[0] == x[0]))


def test_archives_feed_the_concordance(spark, tmp_path):
    paths = []
    for k in range(2):
        write(tmp_path / f"{k}.tar", MEMBERS[k * 60 : k * 60 + 60])
        paths.append(f"file://{tmp_path / f'{k}.tar'}")
    features = archives.archive_properties(spark, paths, 1 << 13)
    kept = concordance.worth_parsing(features, spark.range(110, 130).withColumnRenamed("id", "geoname_id"))
    rows = concordance.parse_features(kept, "city").collect()
    assert sorted(int(r["gn_id"]) for r in rows) == list(range(110, 130)) and all(r["_admissible"] for r in rows)


def test_broken_archives(spark, tmp_path):
    write(tmp_path / "a.tar", MEMBERS[:50])
    data = bytearray((tmp_path / "a.tar").read_bytes())
    write(tmp_path / "one.tar", MEMBERS[120:121])
    (tmp_path / "short.tar").write_bytes((tmp_path / "one.tar").read_bytes()[: 512 * 9])
    with pytest.raises(Exception, match="archive ends inside"):
        archives.archive_members(spark, f"file://{tmp_path}/short.tar", 512).count()
    second = archives.after(0, len(MEMBERS[0][1]))
    data[second] ^= 1
    (tmp_path / "bad.tar").write_bytes(data)
    with pytest.raises(Exception, match="invalid archive header"):
        archives.archive_members(spark, f"file://{tmp_path}/bad.tar", 4096).count()
    (tmp_path / "none.tar").write_bytes(bytes(1024))
    assert archives.archive_members(spark, f"file://{tmp_path}/none.tar").count() == 0


def test_base_256_sizes():
    block = bytearray(tarfile.TarInfo("x.geojson").tobuf()[:512])
    block[124:136] = b"\x80" + (10**10).to_bytes(11, "big")
    block[148:156] = b" " * 8
    block[148:156] = b"%06o\0 " % sum(block)
    assert archives.header_fields(bytes(block)) == ("x.geojson", 10**10, True) and archives.header_fields(bytes(512)) is None


def test_tasks_do_not_grow_with_small_splits(spark, tmp_path, monkeypatch):
    """Two archives of some 60 splits each at the stated size are read by eight in each pass, and in one job a pass."""
    paths = []
    for k in range(2):
        write(tmp_path / f"{k}.tar", MEMBERS[k * 60 : k * 60 + 60])
        paths.append(f"file://{tmp_path / f'{k}.tar'}")
    whole = sorted(archives.archive_members(spark, paths[0], 1 << 10).unionAll(archives.archive_members(spark, paths[1], 1 << 10)).collect())
    stored = []
    usual = archives.materialise
    monkeypatch.setattr(archives, "MAX_SPLITS", 8)
    monkeypatch.setattr(archives, "materialise", lambda df: stored.append(df.rdd.getNumPartitions()) or usual(df))
    assert sorted(archives.archive_members(spark, paths, 1 << 10).collect()) == whole and len(whole) == 120
    assert len(stored) == 2 and max(stored) <= 8 + len(paths)
