"""Kinds of binary formats by value."""

import pytest

from sieveworks.sources.content import is_binary
from sieveworks.sources.signatures import FORMATS, format_of, signature_type

SPACE = b"\0" * 40
CASES = {
    ("application", "wasm"): [b"\0asm\1\0\0\0"], ("application", "dex"): [b"dex\n" + b"0" * 32 + b"p"], ("application", "dey"): [b"dey\n" + b"0" * 36 + b"dex\n" + b"0" * 32 + b"p" + b"0" * 30],
    ("image", "png"): [b"\x89PNG"], ("image", "tiff"): [b"II*\0" + SPACE, b"MM\0*" + SPACE], ("image", "webp"): [b"RIFF1234WEBP"], ("image", "bmp"): [b"BM"],
    ("image", "heif"): [b"\0\0\0\x10ftypheic00000", b"\0\0\0\x18ftypmif10000miafheic", b"\0\0\0\x18ftypmsf10000heicxxxx"],
    ("video", "mp4"): [b"\0\0\0\x20ftypisom", b"0000ftypF4V "], ("video", "matroska"): [b"\x1a\x45\xdf\xa3\xa3\x42\x82\x88matroska", b"\x1a\x45\xdf\xa3\x9f\x42\x82\x84webm"], ("video", "mpeg"): [b"\0\0\1\xba", b"\0\0\1\xb3"],
    ("video", "quicktime"): [b"0000moov" + SPACE, b"012345678901mdat"], ("video", "avi"): [b"RIFF0000AVI "], ("audio", "mp3"): [b"ID3", b"\xff\xfb"], ("audio", "wav"): [b"RIFF0000WAVE"], ("audio", "amr"): [b"#!AMR\n"],
    ("application", "woff"): [b"wOFF\0\1\0\0", b"wOF2\0\1\0\0"], ("application", "ttf"): [b"\0\1\0\0\0"], ("application", "ole"): [b"\xd0\xcf\x11\xe0", b"\xd0\xcf\x11\xe0" + b"0" * 508 + b"\xec\xa5"],
    ("application", "zip"): [b"PK\3\4", b"PK\5\6", b"PK\7\x08"], ("application", "tar"): [b"0" * 257 + b"ustar"], ("application", "rar"): [b"Rar!\x1a\7\0", b"Rar!\x1a\7\1"],
    ("application", "zstd"): [b"\x28\xb5\x2f\xfd", b"\x50\x2a\x4d\x18\2\0\0\0ab\x28\xb5\x2f\xfd", b"\x5f\x2a\x4d\x18\0\0\0\0\x50\x2a\x4d\x18\1\0\0\0a\x28\xb5\x2f\xfd"],
    ("application", "pdf"): [b"%PDF-1.7"], ("application", "rtf"): [b"{\\rtf1"], ("application", "eot"): [b"12345678\2\0\1" + b"0" * 23 + b"LP"], ("application", "elf"): [b"\x7fELF" + b"0" * 60], ("application", "dicom"): [b"0" * 128 + b"DICM"],
    ("application", "iso"): [b"0" * 32769 + b"CD001"], ("application", "macho"): [b"\xca\xfe\xba\xbe"], ("application", "compress"): [b"\x1f\xa0", b"\x1f\x9d"], ("application", "swf"): [b"CWS", b"FWS"],
}
NONE = [
    b"", b"hello", b"PK", b"PK\1\2", b"dex\n" + b"0" * 40, b"dey\n" + b"0" * 100, b"II*\0", b"\x1a\x45\xdf\xa3" + b"x" * 5000 + b"\x42\x82\x84webm", b"\x1a\x45\xdf\xa3webm", b"\0\0\0\x10ftypmif10000heic", b"\0\0\2\x00ftypheic00000",
    b"\xd0\xcf\x11\xe0" + b"0" * 600, b"\x7fELF", b"RIFF0000XXXX", b"\x50\x2a\x4d\x18\xff\0\0\0ab\x28\xb5\x2f\xfd", b"\x50\x2a\x4d\x18", b"0" * 256 + b"ustar",
]


@pytest.mark.parametrize("want", CASES)
def test_formats(want):
    assert [format_of(x) for x in CASES[want]] == [want] * len(CASES[want])


def test_what_is_none():
    # A file that begins with an icon's or a picture's signature is none of the later formats.
    assert [format_of(x) for x in NONE] == [None] * len(NONE)
    assert format_of(b"\0\0\1\0" + b"0" * 253 + b"ustar")[0] == "image"


def test_kinds_are_asked_in_order():
    kinds = [f[0] for f in FORMATS]
    assert [k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k] == ["first", "image", "video", "audio", "font", "document", "archive"]


def test_columns(spark):
    rows = [(i, bytearray(x), want[0]) for i, (want, xs) in enumerate(CASES.items()) for x in xs] + [(100 + i, bytearray(x), None) for i, x in enumerate(NONE)] + [(200, None, None)]
    df = spark.createDataFrame(rows, "i int, content binary, want string")
    got = df.select("want", signature_type(df.content).alias("got"), is_binary(df.content, False).alias("skipped")).collect()
    assert all(r.want == r.got and r.skipped == (r.want == "application") for r in got) and len(got) == len(rows)
