"""Character encodings: labels, decoding with replacement or refusal, encoding, sniffing."""

from __future__ import annotations

import re

from .errors import TextError

#: Fixed values of the Encoding Standard: names by the labels they answer to.
_LABELS = {
    "UTF-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "IBM866": "866 cp866 csibm866 ibm866",
    "KOI8-R": "cskoi8r koi koi8 koi8-r koi8_r",
    "KOI8-U": "koi8-ru koi8-u",
    "macintosh": "csmacintosh mac macintosh x-mac-roman",
    "windows-874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "windows-1252": "ansi_x3.4-1968 ascii cp1252 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii windows-1252 x-cp1252",
    "windows-1254": "cp1254 csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5 windows-1254 x-cp1254",
    "GBK": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "Big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "EUC-JP": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "ISO-2022-JP": "csiso2022jp iso-2022-jp",
    "Shift_JIS": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "EUC-KR": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "UTF-16BE": "unicodefffe utf-16be",
    "UTF-16LE": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
    "replacement": "csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr replacement",
    "x-user-defined": "x-user-defined",
}
_CODECS = {"UTF-8": "utf-8", "IBM866": "cp866", "KOI8-R": "koi8-r", "KOI8-U": "koi8-u", "macintosh": "mac-roman", "windows-874": "cp874", "GBK": "gb18030", "gb18030": "gb18030", "Big5": "big5hkscs", "EUC-JP": "euc-jp", "ISO-2022-JP": "iso-2022-jp", "Shift_JIS": "cp932", "EUC-KR": "cp949", "UTF-16BE": "utf-16-be", "UTF-16LE": "utf-16-le"}


def _by_label() -> dict[str, str]:
    found = {label: name for name, labels in _LABELS.items() for label in labels.split()}
    for n in (1250, 1251, 1253, 1255, 1256, 1257, 1258):
        found |= {f"{p}{n}": f"windows-{n}" for p in ("cp", "windows-", "x-cp")}
    for n, extra in {2: "l2 latin2 csisolatin2 iso-ir-101", 3: "l3 latin3 csisolatin3 iso-ir-109", 4: "l4 latin4 csisolatin4 iso-ir-110", 5: "cyrillic csisolatincyrillic iso-ir-144", 6: "arabic asmo-708 ecma-114 csisolatinarabic iso-ir-127", 7: "greek greek8 ecma-118 elot_928 sun_eu_greek csisolatingreek iso-ir-126", 8: "hebrew visual csisolatinhebrew iso-ir-138", 10: "l6 latin6 csisolatin6 iso-ir-157", 13: "", 14: "", 15: "l9 csisolatin9", 16: ""}.items():
        found |= {x: f"ISO-8859-{n}" for x in (f"iso-8859-{n}", f"iso8859-{n}", f"iso8859{n}", f"iso_8859-{n}", *extra.split())}
    found |= {"logical": "ISO-8859-8-I", "iso-8859-8-i": "ISO-8859-8-I", "csiso88598i": "ISO-8859-8-I", "x-mac-cyrillic": "x-mac-cyrillic", "x-mac-ukrainian": "x-mac-cyrillic"}
    return found


LABELS = _by_label()


def for_label(label: str) -> str | None:
    """Encoding name of a label; ASCII white space around it and its case do not count."""
    return LABELS.get(label.strip("\t\n\f\r ").lower())


def _codec(name: str) -> str:
    if name in _CODECS:
        return _CODECS[name]
    if m := re.fullmatch(r"windows-(\d+)", name):
        return f"cp{m[1]}"
    return "mac-cyrillic" if name == "x-mac-cyrillic" else name.lower().removesuffix("-i")


def decode(data: bytes, name: str, errors: str = "replacement", bom: bool = True) -> str:
    """Text of bytes; ``errors``: replacement or fatal. A byte order mark wins over ``name`` if ``bom``."""
    if bom:
        for mark, own in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xfe\xff", "UTF-16BE"), (b"\xff\xfe", "UTF-16LE")):
            if data.startswith(mark):
                name, data = own, data[len(mark) :]
                break
    if name == "replacement":
        if errors == "fatal" and data:
            raise TextError("decode", "the encoding is not decoded", "", 0)
        return "�" if data else ""
    if name == "x-user-defined":
        return "".join(chr(b if b < 128 else 0xF780 + b - 128) for b in data)
    single = not name.startswith(("UTF", "GB", "gb", "Big5", "EUC", "ISO-2022", "Shift"))
    try:
        return data.decode(_codec(name))
    except UnicodeDecodeError as e:
        if single and name.startswith("windows"):
            # the standard maps the holes of windows code pages to C1 controls
            out = "".join(_one(b, _codec(name)) for b in data)
            if "�" not in out or errors != "fatal":
                return out
        if errors == "fatal":
            raise TextError("decode", e.reason, "", e.start) from None
        return data.decode(_codec(name), "replace")


def _one(b: int, codec: str) -> str:
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b) if 0x80 <= b <= 0x9F else "�"


def encode(text: str, name: str, errors: str = "fatal") -> bytes:
    """Bytes of text; ``errors``: fatal, replacement (?) or html (character references)."""
    if name in ("replacement", "UTF-16BE", "UTF-16LE"):
        name = "UTF-8"
    if name == "x-user-defined":
        try:
            return bytes(ord(c) if ord(c) < 128 else ord(c) - 0xF780 + 128 for c in text)
        except ValueError:
            raise TextError("encode", "character is outside the encoding") from None
    try:
        return text.encode(_codec(name), {"fatal": "strict", "replacement": "replace", "html": "xmlcharrefreplace"}[errors])
    except UnicodeEncodeError as e:
        raise TextError("encode", e.reason, text, e.start) from None


def sniff(data: bytes, transport: str | None = None, default: str = "windows-1252") -> tuple[str, str]:
    """(encoding, confidence) of an HTML file: byte order mark, transport label, meta in the first 1024 bytes, default."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xfe\xff", "UTF-16BE"), (b"\xff\xfe", "UTF-16LE")):
        if data.startswith(mark):
            return name, "certain"
    if transport and (name := for_label(transport)):
        return name, "certain"
    head = re.sub(rb"<!--.*?(?:-->|\Z)", b"", data[:1024], flags=re.S)
    for m in re.finditer(rb"<meta[\s/]([^>]*)", head, re.I):
        found = re.search(rb"charset\s*=\s*[\"']?\s*([^\s\"'/>;]+)", m[1], re.I)
        if found and (name := for_label(found[1].decode("latin-1"))):
            return ("UTF-8" if name.startswith("UTF-16") else "windows-1252" if name == "x-user-defined" else name), "tentative"
    return default, "tentative"
