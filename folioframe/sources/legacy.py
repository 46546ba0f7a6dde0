"""Texts in old Vietnamese encodings."""

from __future__ import annotations

import unicodedata

#: Letters of TCVN 5712 by their bytes.
TCVN3 = dict(
    zip(
        [*range(0xA1, 0xAF), *range(0xB5, 0xBA), *range(0xBB, 0xBF), *range(0xC6, 0xCD), *range(0xCE, 0xD9), *range(0xDC, 0xE0), *range(0xE1, 0xFF)],
        "ĂÂÊÔƠƯĐăâêôơưđ" "àảãáạ" "ằẳẵắ" "ặầẩẫấậè" "ẻẽéẹềểễếệìỉ" "ĩíịò" "ỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ",
    )
)

_TONES = {"grave": "\u0300", "acute": "\u0301", "hook": "\u0309", "tilde": "\u0303", "dot": "\u0323"}


def _vni() -> dict[str, str]:
    """Pairs of a letter and its mark: the marks of plain, circumflex and breve letters, in either case."""
    plain = dict(zip("øùûõï", _TONES.values()))
    hat = {"â": "\u0302", **{m: "\u0302" + t for m, t in zip("àáåãä", _TONES.values())}}
    breve = {"ê": "\u0306", **{m: "\u0306" + t for m, t in zip("èéúüë", _TONES.values())}}
    out = {}
    for base in "aeouyôö":
        letter = {"ô": "ơ", "ö": "ư"}.get(base, base)
        marks = {**plain, **(hat if base in "aeo" else {}), **(breve if base == "a" else {})}
        for m, t in marks.items():
            out[base + m] = unicodedata.normalize("NFC", letter + t)
    out |= {"ñ": "đ", "ô": "ơ", "ö": "ư", "æ": "ỉ", "ó": "ĩ", "ò": "ị", "î": "ỵ"}
    return out | {k.upper(): v.upper() for k, v in out.items()}


VNI = _vni()
LEAST_HITS, LEAST_SHARE = 3, 0.7
VIETNAMESE = set("ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ")


def from_tcvn3(data: bytes) -> str:
    return "".join(TCVN3.get(b, chr(b)) for b in data)


def from_vni(text: str) -> str:
    """Text whose letters and marks were read one byte each."""
    out, i = [], 0
    while i < len(text):
        if (pair := text[i : i + 2]) in VNI and len(pair) == 2:
            out.append(VNI[pair])
            i += 2
        else:
            out.append(VNI.get(text[i], text[i]))
            i += 1
    return "".join(out)


def decode_text(data: bytes) -> str:
    """UTF-8 (a mark of byte order goes); else the old encoding whose letters nearly all high bytes are; else UTF-8
    with replacement characters, so no line is lost."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    data = data.removeprefix(b"\xef\xbb\xbf")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    high = [b for b in data if b >= 0x80]
    hits = sum(b in TCVN3 for b in high)
    latin = data.decode("cp1252", "replace")
    pairs = sum(latin[i : i + 2] in VNI for i in range(len(latin) - 1)) + latin.count("ñ")
    if pairs >= LEAST_HITS and pairs >= LEAST_SHARE * len(high):
        return from_vni(latin)
    if hits >= LEAST_HITS and hits >= LEAST_SHARE * len(high):
        return from_tcvn3(data)
    return data.decode("utf-8", "replace")
