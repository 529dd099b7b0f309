"""Kinds of binary formats by signatures at fixed offsets, found by one walk over a trie for each offset."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes at the beginning of a file that decide.
PROBE = 100_000

# Published signatures. A line is a kind of media, a name, the least number of bytes, and what
# must stand where: an offset and bytes, as hexadecimal digits or in quotes; / parts alternatives. Kinds come
# in the order in which they are asked.
_FORMATS = """
first wasm 8 0:0061736D01000000
first dex 37 0:6465780A 36:'p'
first dey 101 0:6465790A 40:6465780A 76:'p'
image jpeg 3 0:FFD8FF
image jp2 13 0:0000000C6A5020200D0A870A00
image png 4 0:89504E47
image gif 3 0:'GIF'
image webp 12 8:'WEBP'
image tiff 11 0:49492A00/4D4D002A
image bmp 2 0:'BM'
image jxr 3 0:4949BC
image psd 4 0:'8BPS'
image ico 4 0:00000100
image dwg 4 0:'AC10'
image heif 17 4:'ftyp' 8:'heic'/'mif1'/'msf1'
video mp4 12 4:'ftyp' 8:'avc1'/'dash'/'iso2'/'iso3'/'iso4'/'iso5'/'iso6'/'isom'/'mmp4'/'mp41'/'mp42'/'mp4v'/'mp71'/'MSNV'/'NDAS'/'NDSC'/'NSDC'/'NDSH'/'NDSM'/'NDSP'/'NDSS'/'NDXC'/'NDXH'/'NDXM'/'NDXP'/'NDXS'/46345620/46345020
video m4v 11 4:'ftypM4V'
video matroska 4 0:1A45DFA3
video quicktime 16 0:0000001466747970
video quicktime 16 4:'moov'/'mdat'
video quicktime 16 12:'mdat'
video avi 11 0:'RIFF' 8:'AVI'
video wmv 10 0:3026B2758E66CF11A6D9
video mpeg 4 0:000001B0/000001B1/000001B2/000001B3/000001B4/000001B5/000001B6/000001B7/000001B8/000001B9/000001BA/000001BB/000001BC/000001BD/000001BE/000001BF
video flv 4 0:464C5601
video 3gp 11 4:'ftyp3gp'
audio midi 4 0:'MThd'
audio mp3 2 0:'ID3'/FFFB
audio m4a 4 0:4D344120
audio m4a 11 4:'ftypM4A'
audio ogg 4 0:'OggS'
audio flac 4 0:'fLaC'
audio wav 12 0:'RIFF' 8:'WAVE'
audio amr 6 0:2321414D520A
audio aac 2 0:FFF1/FFF9
audio aiff 12 0:'FORM' 8:'AIFF'
font woff 8 0:774F464600010000/774F463200010000
font ttf 5 0:0001000000
font otf 5 0:4F54544F00
document ole 4 0:D0CF11E0
archive zip 4 0:504B0304/504B0306/504B0308/504B0504/504B0506/504B0508/504B0704/504B0706/504B0708
archive tar 262 257:'ustar'
archive rar 7 0:526172211A0700/526172211A0701
archive gzip 3 0:1F8B08
archive bzip2 3 0:'BZh'
archive 7z 6 0:377ABCAF271C
archive xz 6 0:FD377A585A00
archive zstd 4 0:28B52FFD
archive pdf 4 0:'%PDF'
archive exe 2 0:'MZ'
archive swf 3 0:'CWS'/'FWS'
archive rtf 5 0:'{\\rtf'
archive eot 36 34:'LP' 8:020001/010000/020002
archive ps 2 0:'%!'
archive sqlite 4 0:'SQLi'
archive nes 4 0:4E45531A
archive crx 4 0:'Cr24'
archive cab 4 0:'MSCF'/'ISc('
archive ar 7 0:'!<arch>'
archive compress 2 0:1FA0/1F9D
archive lzip 4 0:'LZIP'
archive rpm 97 0:EDABEEDB
archive elf 53 0:7F454C46
archive dicom 132 128:'DICM'
archive iso 32774 32769:'CD001'
archive macho 4 0:FEEDFACF/FEEDFACE/BEBAFECA/CFFAEDFE/CEFAEDFE/CAFEBABE
"""
#: The top-level media type that each kind counts as.
KINDS = {"first": "application", "image": "image", "video": "video", "audio": "audio", "font": "application", "document": "application", "archive": "application"}


def _literal(text: str) -> bytes:
    return text[1:-1].encode("latin-1") if text[0] == "'" else bytes.fromhex(text)


class _Trie:
    """The byte strings that may stand at one offset, each with the parts of formats that it fills."""

    def __init__(self) -> None:
        self.steps: dict[int, _Trie] = {}
        self.parts: list[tuple[int, int]] = []

    def add(self, data: bytes, part: tuple[int, int]) -> None:
        node = self
        for b in data:
            node = node.steps.setdefault(b, _Trie())
        node.parts.append(part)

    def walk(self, data: bytes, at: int) -> list[tuple[int, int]]:
        """The parts of all byte strings that stand at this offset."""
        node, out = self, []
        while at < len(data) and (node := node.steps.get(data[at])) is not None:
            out += node.parts
            at += 1
        return out


def _load() -> tuple[list[tuple[str, str, int, int]], dict[int, _Trie]]:
    formats, tries = [], {}
    for i, line in enumerate(_FORMATS.strip().split("\n")):
        kind, name, least, *parts = line.split(" ")
        formats.append((kind, name, int(least), len(parts)))
        for k, part in enumerate(parts):
            offset, _, some = part.partition(":")
            for text in some.split("/"):
                tries.setdefault(int(offset), _Trie()).add(_literal(text), (i, k))
    return formats, tries


FORMATS, TRIES = _load()


def _heif(data: bytes) -> bool:
    """Of the brands in the box at the beginning one is heic."""
    size = int.from_bytes(data[:4], "big")
    return size <= len(data) and (data[8:12] == b"heic" or any(data[i : i + 4] == b"heic" for i in range(16, size - 3, 4)))


def _matroska(data: bytes) -> bool:
    """The document type is named behind its element's id and length."""
    return any((i := data.find(name, 0, 4096)) >= 3 and data[i - 3 : i - 1] == b"\x42\x82" for name in (b"matroska", b"webm"))


def _ole(data: bytes) -> bool:
    return len(data) <= 513 or data[512:514] in (b"\xec\xa5", b"\x09\x08", b"\xa0\x46")


#: What some formats ask for besides their signature.
ALSO = {"heif": _heif, "matroska": _matroska, "ole": _ole}


def _behind_skipped(data: bytes) -> bytes:
    """What follows the skippable frames of a Zstandard stream."""
    at = 0
    while len(data) - at >= 8 and data[at] & 0xF0 == 0x50 and data[at + 1 : at + 4] == b"\x2a\x4d\x18":
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if size > len(data) - at - 8:
            return b""
        at += 8 + size
    return data[at:] if at else b""


def format_of(data: bytes) -> tuple[str, str] | None:
    """(media type, name) of the first format, in their order, whose signature is in the first bytes."""
    filled: dict[int, set[int]] = {}
    for offset, trie in TRIES.items():
        for i, k in trie.walk(data, offset):
            filled.setdefault(i, set()).add(k)
    for i in sorted(filled):
        kind, name, least, parts = FORMATS[i]
        if len(filled[i]) == parts and len(data) >= least and ALSO.get(name, bool)(data):
            return KINDS[kind], name
    rest = _behind_skipped(data)
    return ("application", "zstd") if rest.startswith(b"\x28\xb5\x2f\xfd") else None


def signature_type(content: Column) -> Column:
    """The top-level media type of a binary format by its signature; null for all else."""

    @F.arrow_udf("string")
    def types(heads: pa.Array) -> pa.Array:
        return pa.array([found[0] if h.is_valid and (found := format_of(h.as_py())) else None for h in heads], pa.string())

    return types(F.substring(content, 1, PROBE))
