import hashlib
import tarfile
import zlib

from lexvane.llm.media import decode_image, encode_image, media_columns, payload_of


def test_image_round_trip():
    for raw in (b"", b"a", bytes(range(256)) * 9, b"x" * 576, b"x" * 577):
        assert decode_image(encode_image(payload_of(raw))) == payload_of(raw)


def test_media(odd, nothing):
    rows = media_columns(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in rows:
        p = payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (r.width, r.height, r.bit_depth) == (576, len(p) // 576, 8)
        with open(r.shard, "rb") as f:
            f.seek(r.offset)
            image = f.read(r.media_bytes)
        assert hashlib.sha256(image).hexdigest() == r.media_sha256 and decode_image(image) == p
        with tarfile.open(r.shard) as t:
            assert t.extractfile(f"{r.payload_sha256}.png").read() == image
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (6, 7)}) == 1
    assert media_columns(nothing).count() == 0
