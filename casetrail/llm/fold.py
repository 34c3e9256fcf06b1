"""Which characters look alike: tables built from Unicode's own data, shared by all text operators.

A text's folded form keeps what a reader sees (case, accents, digits, raised digits, punctuation,
line breaks) and drops what nobody sees (zero-width characters, kinds of blanks, compatibility forms,
letters of another script with the shape of a Latin one).
"""

from __future__ import annotations

import functools
import re
import unicodedata as U

# Letters of other scripts with the shape of a Latin letter. Greek small alpha, beta and gamma are seen.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧινορυ"
GREEK_LATIN = "ABEZHIKMNOPTYXivopu"
CYRILLIC = "АВЕЅІЈКМНОРСТХаеорсухѕіјһԁԛԝԚԜҮӀѴѵԌ"
CYRILLIC_LATIN = "ABESIJKMHOPCTXaeopcyxsijhdqwQWYIVvG"
ARMENIAN = "ՕՍՏօոսհցզ"
ARMENIAN_LATIN = "OUSonuhgq"
OTHER = "‐‑µıȷɡɑ⁄∕"
OTHER_LATIN = "--μijga//"
#: Compatibility forms that look like their plain form. Raised and lowered digits, circled forms and the like are seen.
PLAIN_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>"}
#: Beside the format characters (category Cf), these are invisible too.
UNSEEN = "͏ᅟᅠ឴឵" + "".join(map(chr, [*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), 0x3164, 0xFFA0, *range(0xE0100, 0xE01F0)]))
UNSEEN_CLASS = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{FE00}-\x{FE0F}\x{3164}\x{FFA0}\x{E0100}-\x{E01EF}]"
#: Planes with letters and marks; beyond them only the invisible characters of plane 14.
SEEN, PLANE_14 = range(0xA0, 0x20000), range(0xE0000, 0xE0200)


@functools.cache
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """(one character to one, one character to several)."""
    base = dict(zip(GREEK + CYRILLIC + ARMENIAN + OTHER, GREEK_LATIN + CYRILLIC_LATIN + ARMENIAN_LATIN + OTHER_LATIN))
    one, many = dict(base), {}
    for cp in SEEN:
        c = chr(cp)
        if c in one or c in UNSEEN or 0xD800 <= cp < 0xE000:
            continue
        parts = U.decomposition(c).split()
        if not parts:
            if U.category(c) == "Zs":
                one[c] = " "
            continue
        if parts[0].startswith("<"):
            if parts[0] not in PLAIN_TAGS:
                continue
            to = U.normalize("NFC", "".join(base.get(x, x) for x in U.normalize("NFKD", c)))
            if len(to) > 1 and to[0] == " ":
                continue
        else:  # a letter of another script under an accent
            full = U.normalize("NFD", c)
            if full[0] not in base or full[0] in OTHER:
                continue
            to = U.normalize("NFC", base[full[0]] + full[1:])
        if U.category(c) == "Zs":
            to = " "
        if to != c:
            (one if len(to) == 1 else many)[c] = to
    return one, many


@functools.cache
def _python_table() -> tuple[frozenset[str], dict[str, str]]:
    one, many = tables()
    out = {**one, **many, **{c: "" for c in UNSEEN}}
    out |= {chr(cp): "" for cp in (*SEEN, *PLANE_14) if U.category(chr(cp)) == "Cf"}
    return frozenset(out), out


def fold(text: str) -> str:
    """The folded form, in plain Python; equal to what the embedded SQL gives but for end blanks and CR LF."""
    if text.isascii():
        return text
    mapped, table = _python_table()
    for c in mapped.intersection(text):
        text = text.replace(c, table[c])
    return U.normalize("NFC", text)


_MARKS = re.compile("[̀-ͯ]+")


def bare(text: str) -> str:
    """Folded, lower case and without accents: for comparing words, whatever their characters."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", U.normalize("NFD", fold(text).casefold()))
