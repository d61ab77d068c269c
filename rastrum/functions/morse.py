"""Morse code and the licence-plate pattern as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: International Morse code.
CODES = {
    "A": ".-", "B": "-...", "C": "-.-.", "D": "-..", "E": ".", "F": "..-.", "G": "--.", "H": "....", "I": "..", "J": ".---", "K": "-.-", "L": ".-..", "M": "--",
    "N": "-.", "O": "---", "P": ".--.", "Q": "--.-", "R": ".-.", "S": "...", "T": "-", "U": "..-", "V": "...-", "W": ".--", "X": "-..-", "Y": "-.--", "Z": "--..",
    "0": "-----", "1": ".----", "2": "..---", "3": "...--", "4": "....-", "5": ".....", "6": "-....", "7": "--...", "8": "---..", "9": "----.",
    ".": ".-.-.-", ",": "--..--", "?": "..--..", "'": ".----.", "!": "-.-.--", "/": "-..-.", "(": "-.--.", ")": "-.--.-", "&": ".-...",
    ":": "---...", ";": "-.-.-.", "=": "-...-", "+": ".-.-.", "-": "-....-", "_": "..--.-", '"': ".-..-.", "$": "...-..-", "@": ".--.-.",
}
_SPACE = r"[ \t\n\x0B\f\r]"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stand-ins from a private area: one for each character with a code, then for a word's break and for one before a word that starts without a
#: code. A text's own characters of this area have no code; they become OTHER.
_MARKS = [chr(0xE000 + k) for k in range(len(CODES) + 2)]
_CODED = f"[{_MARKS[0]}-{_MARKS[len(CODES) - 1]}]"
_BREAK, _WIDE_BREAK = _MARKS[-2:]
OTHER = "￿"


def encode(text: Column) -> Column:
    """Morse of a text: letters apart by a blank, words by ' / '. Characters without a code vanish: a word without any code goes if no
    word stands before it, a later word that starts with one is set apart by one more blank, and white space at the end leaves a
    separator. Characters become stand-ins, a few patterns set the blanks, and stand-ins become codes, all on whole texts."""
    own = dict(zip(CODES, _MARKS, strict=False))
    letters = {x.lower(): own[x] for x in _UPPER} | own | dict.fromkeys(_MARKS, OTHER)
    other = f"[^{_MARKS[0]}-{_MARKS[len(CODES) - 1]}{_SPACE[1:-1]}]"
    out = F.translate(text, "".join(letters), "".join(letters.values()))
    out = F.regexp_replace(out, f"^[^{_CODED[1:]}*+", "")  # up to the first character with a code
    out = F.regexp_replace(out, f"{_SPACE}++{other}++(?={_CODED})", _WIDE_BREAK)
    out = F.regexp_replace(out, f"{_SPACE}++", _BREAK)
    out = F.regexp_replace(out, f"[^{_MARKS[0]}-{_MARKS[-1]}]++", "")
    out = F.regexp_replace(out, f"({_CODED})(?={_CODED})", "$1 ")
    for mark, code in [*zip(_MARKS, CODES.values(), strict=False), (_BREAK, " / "), (_WIDE_BREAK, " /  ")]:
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def decode(morse: Column) -> Column:
    """Text of Morse code: '/' is a blank, an unknown code '?'."""
    back = {v: k for k, v in CODES.items()} | {"/": " "}
    out = F.translate(morse, "".join(_MARKS), OTHER * len(_MARKS))
    out = F.concat(F.lit(" "), F.regexp_replace(out, f"{_SPACE}++", "  "), F.lit(" "))  # each token between blanks of its own
    for mark, code in zip(_MARKS, back, strict=False):
        out = F.replace(out, F.lit(f" {code} "), F.lit(mark))
    out = F.regexp_replace(out, f" [^ {_MARKS[0]}-{_MARKS[-1]}]++ ", "?")
    out = F.replace(out, F.lit(" "), F.lit(""))
    return F.translate(out, "".join(_MARKS[: len(back)]), "".join(back.values()))


def plate(text: Column) -> Column:
    """The first licence plate in a text whose blanks are taken out; null without one."""
    got = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), r"[A-z]{2}-[0-9]{3}-[A-Z]{2}", 0)
    return F.when(got != "", got)
