import hashlib
import io
import struct

import pytest

from threadloom.llm import warc


def expected(rows):
    heads = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000 and i is not None:
            heads[h] = max(i, heads.get(h, i))
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        head = heads.get(h)
        revisit = head is not None and i != head
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [0, 300])
def test_archives_round_trip(spark, tmp_path, prose, many):
    same, short = "<p>" + "é" * 500, "x" * 999
    rows = [(1, "http://a/", same), (9, "http://b/", same), (4, None, same), (None, "http://c d\r\n/", same), (2, "u", short), (3, "u", short), (5, "u", None), (6, "u", ""), (6, "u", "")]
    rows += [(7, "u", "y" * 1000), (7, "u", "y" * 1000), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (10, "long", "w " * 300_000)]
    rows += [(100 + k, f"http://h/{k}", f"<html><head><title>{k}</title></head><body>{prose(k, 120)}</body></html>") for k in range(many)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest, folder = warc.archive(pages, folder=f"file://{tmp_path}/w")
    got = warc.read(manifest, folder, payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    heads = [p.read_bytes()[:4] for p in (tmp_path / "w").glob("*.warc.zst")]
    assert not many or all(struct.unpack("<I", h)[0] == warc.DICTIONARY_MAGIC for h in heads)


def test_no_pages(spark, tmp_path):
    manifest, folder = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), folder=f"file://{tmp_path}/w")
    assert warc.read(manifest, folder).count() == 0


def test_dictionary_shrinks_small_records(prose):
    pages = [f"<html><head><title>{k}</title></head><body>{prose(k, 40)}</body></html>".encode() for k in range(400)]
    dictionary = warc.build_dictionary(pages[:300])
    assert dictionary
    sizes = []
    for d in (dictionary, b""):
        head, pack = warc.open_archive(d)
        frames = [pack.compress(warc.record(f"x:{k}", "response", k, "u", p, hashlib.sha1(p).hexdigest(), len(p), None, "2024-01-01T00:00:00Z")) for k, p in enumerate(pages)]
        back = [warc.parse(r)["payload"] for r in warc.records(io.BytesIO(head + b"".join(frames)), chunk=97)]
        assert back == pages
        sizes.append(sum(map(len, frames)))
    assert sizes[0] < 0.9 * sizes[1]


def test_damage_is_noticed():
    p = b"payload"
    good = warc.record("x", "response", 1, "u", p, hashlib.sha1(p).hexdigest(), len(p), None, "d")
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload", b"paYload"))
    head, pack = warc.open_archive(b"")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(pack.compress(good)[:-3])))
