import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from helpers import corpus, frame, with_oddities

from keelson.llm import media


def png():
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\0")) + part(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"


def jpeg():
    return b"\xff\xd8\xff\xe0\x00\x10JFIF" + bytes(10) + b"\xff\xda\x00\x08" + bytes(6) + b"\x12\xff\x00\x34" + b"\xff\xd9"


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
KNOWN = {"image/png": png(), "image/gif": gif(), "image/jpeg": jpeg(), "image/bmp": bmp(), "application/zip": zipped(), "application/gzip": gzip.compress(b"hi" * 50), "audio/wav": media.as_wav(b"abc"), "application/pdf": PDF}


def test_every_format_is_confirmed_whole_and_embedded():
    for kind, data in KNOWN.items():
        assert media.sniff(data) == (kind, [(kind, 0, len(data))])
        got = media.sniff(b"text BM RIFF GIF89a " + data + (b"" if kind in ("application/pdf", "application/zip") else b" tail"))
        assert (kind, 20, len(data)) in got[1]


def test_broken_media_are_not_confirmed():
    for kind, data in KNOWN.items():
        if kind != "application/pdf":
            assert media.sniff(data[:-1])[0] == media.UNKNOWN, kind
    bad = bytearray(png())
    bad[20] ^= 1
    assert media.sniff(bytes(bad)) == (media.UNKNOWN, [])


def crc(data, poly, bits):
    x = 0
    for byte in data:
        x ^= byte << bits - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x >> bits - 1 else 0)) & (1 << bits) - 1
    return x.to_bytes(bits // 8, "big")


def flac(total, frames=2):
    """Mono, 8 bits, 16 samples a frame: constant, verbatim, and fixed of order 1 with Rice codes in turn."""
    info = struct.pack(">HH", 16, 16) + bytes(6) + (8000 << 44 | 7 << 36 | total).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + info
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x60, 0x02, k, 15])
        rice = "0" + "001001" + "0" + f"{7:08b}" + "00" + "0000" + "0001" + "".join("0" * (j % 3) + "1" + str(j % 2) for j in range(15))
        bits = ["0" + "000000" + "0" + f"{9:08b}", "0" + "000001" + "0" + "".join(f"{200 + j:08b}" for j in range(16)), rice][k % 3]
        bits += "0" * (-len(bits) % 8)
        frame = head + crc(head, 0x07, 8) + int(bits, 2).to_bytes(len(bits) // 8, "big")
        out += frame + crc(frame, 0x8005, 16)
    return out


def test_flac_ends_at_its_last_frame():
    for total, frames in ((48, 3), (0, 3), (40, 3), (32, 2)):
        f = flac(total, frames)
        assert media.sniff(f) == ("audio/flac", [("audio/flac", 0, len(f))])
        assert media.sniff(f + png()) == (media.UNKNOWN, [("audio/flac", 0, len(f)), ("image/png", len(f), len(png()))])
    assert media.sniff(flac(48, 3)[:-1])[1] == media.sniff(flac(64, 3))[1] == []
    bad = bytearray(flac(48, 3))
    bad[-5] ^= 1
    assert media.sniff(bytes(bad))[1] == []


def test_pdf_ends_at_its_own_end():
    n, m = len(PDF), len(png())
    assert media.sniff(PDF + png() + PDF) == (media.UNKNOWN, [("application/pdf", 0, n), ("image/png", n, m), ("application/pdf", n + m, n)])
    update = b"\n1 0 obj\nendobj\nstartxref\n%d\n%%%%EOF" % (n + 1)
    assert media.sniff(PDF + update) == ("application/pdf", [("application/pdf", 0, n + len(update))])
    assert media.sniff(PDF.replace(b"9", b"9999"))[1] == []


def test_operator_corrects_and_carves(spark):
    both = b"xx" + png() + gif()
    rows = [(1, png(), "image/gif"), (2, both, None), (3, None, "image/png"), (4, b"", "image/png")]
    got = {r.id: r for r in media.sniff_media(spark.createDataFrame(rows, "id long, blob binary, said string"), "id", "blob", "said").collect()}
    assert (got[1].media_type, got[1].corrected, got[1].carved) == ("image/png", True, [])
    assert [bytes(c.data) for c in got[2].carved] == [png(), gif()]
    assert got[3].media_type == got[4].media_type == media.UNKNOWN


def test_texts_round_trip(spark):
    rows = with_oddities(corpus())
    got = media.read_features(media.store_texts(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = next(x for x in by[i] if x.payload_sha256 == hashlib.sha256(full).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(full), zlib.crc32(full[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.as_wav(full)).hexdigest() and r.media_bytes == len(media.as_wav(full))
        assert r.feature.startswith("audio/wav")
    assert media.read_features(media.store_texts(frame(spark, []))).count() == 0
