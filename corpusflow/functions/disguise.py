"""Undoing disguises before text is judged: what was hidden, in which way, and the plain form.

Two kinds of findings are collected and everything else is read off them. Characters that stand for others are looked up
in one table. Blocks (encoded runs, rotated text, letters written as digits) are spans with a kind and a reading; the
plain form is the text with each reading after its span, the signals are counts of findings.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import ENCLOSED, INVISIBLE, LATIN, LOOKALIKES, OPENED, once

# The words whose number tells rotated from plain text.
PLAIN_WORDS = set("the and that ignore previous instructions system prompt secret password tell write give show explain answer who what where how when apa siapa apakah bagaimana mengapa siapa yang ini itu untuk abaikan instruksi sebelumnya sistem rahasia jawab".split())
# International Morse code.
MORSE = {
    "A": ".-", "B": "-...", "C": "-.-.", "D": "-..", "E": ".", "F": "..-.", "G": "--.", "H": "....", "I": "..", "J": ".---", "K": "-.-", "L": ".-..", "M": "--",
    "N": "-.", "O": "---", "P": ".--.", "Q": "--.-", "R": ".-.", "S": "...", "T": "-", "U": "..-", "V": "...-", "W": ".--", "X": "-..-", "Y": "-.--", "Z": "--..",
    "0": "-----", "1": ".----", "2": "..---", "3": "...--", "4": "....-", "5": ".....", "6": "-....", "7": "--...", "8": "---..", "9": "----.",
}
# Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
SCHEMA = T.StructType([T.StructField("canonical", T.StringType()), T.StructField("transforms", T.ArrayType(T.StringType())), T.StructField("signals", T.MapType(T.StringType(), T.IntegerType()))])

#: What a character is and what it stands for.
CHARACTERS = {c: ("hidden", "") for c in INVISIBLE} | {c: ("homoglyph", to) for c, to in zip(LOOKALIKES, LATIN, strict=True)} | {c: ("emoji_cipher", to) for c, to in zip(ENCLOSED, OPENED, strict=True)}
_MORSE_LETTERS = {code: letter for letter, code in MORSE.items()}


def _text_of(data: bytes | None) -> str | None:
    """Bytes as text, if nearly all of it shows."""
    try:
        text = (data or b"").decode()
    except UnicodeDecodeError:
        return None
    hidden = sum(c < " " and c not in "\n\r\t" or c == "\x7f" for c in text)
    return text if text.strip() and len(text) - hidden > 0.85 * len(text) else None


def _base64(run: str) -> str | None:
    try:
        return _text_of(base64.b64decode(run, validate=True))
    except (binascii.Error, ValueError):
        return None


def _hex(run: str) -> str | None:
    digits = run.removeprefix("0x")
    return _text_of(bytes.fromhex(digits)) if len(digits) % 2 == 0 else None


def _morse(run: str) -> str | None:
    words = ["".join(_MORSE_LETTERS.get(code, "\0") for code in word.split()) for word in run.split("/")]
    return None if "\0" in "".join(words) or "" in words else " ".join(words)


def _rot13(text: str) -> str | None:
    """The rotated text, if it has at least two plain words more."""
    turned = codecs.encode(text, "rot13")
    plain = [sum(w in PLAIN_WORDS for w in re.findall("[a-z]{4,}", t.lower())) for t in (text, turned)]
    return turned if plain[1] > plain[0] + 1 else None


def _leet(word: str) -> str | None:
    """The word in letters, if two signs or more stand for letters and letters outnumber digits."""
    signs, letters, digits = sum(c in LEET for c in word), sum(map(str.isalpha, word)), sum(map(str.isdigit, word))
    return "".join(LEET.get(c, c) for c in word) if signs > 1 and letters > max(1, digits) else None


@dataclass(frozen=True)
class Kind:
    step: str
    signal: str
    shown: str
    shape: re.Pattern
    read: Callable[[str], str | None]
    #: The signal of a block without a reading; without one, such a run is no block.
    unread: str | None = None


# The shapes of encoded blocks, and the names that findings go by.
KINDS = [
    Kind("base64_decoded", "base64_block", "b64-decoded", re.compile(r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[g-zG-Z+/=])[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/=])"), _base64, "base64_undecodable"),
    Kind("hex_decoded", "hex_block", "hex-decoded", re.compile(r"(?<![0-9a-fA-Fx])(?:0x)?[0-9a-fA-F]{16,}(?![0-9a-fA-F])"), _hex, "hex_undecodable"),
    Kind("morse_decoded", "morse_block", "morse-decoded", re.compile(r"(?<![.\-/])[.\-]+(?:[ /]+[.\-]+){2,}(?![.\-/])"), _morse, "morse_undecodable"),
    Kind("rot13_decoded", "rot13", "rot13-decoded", re.compile(r"(?s)\A.+\Z"), _rot13),
    Kind("leetspeak_normalized", "leetspeak", "deleet", re.compile(r"\b[A-Za-z0-9@!$]{3,12}\b"), _leet),
]


@dataclass
class Finding:
    kind: Kind
    end: int
    reading: str | None


def findings(text: str, kind: Kind) -> Iterator[Finding]:
    for m in kind.shape.finditer(text):
        reading = kind.read(m[0])
        if reading is not None or kind.unread:
            yield Finding(kind, m.end(), reading)


def with_readings(text: str, found: list[Finding]) -> str:
    out, at = [], 0
    for f in found:
        if f.reading is not None:
            out += [text[at : f.end], f" ({f.kind.shown}: {f.reading})"]
            at = f.end
    return "".join([*out, text[at:]])


def undisguised(text: str | None) -> tuple[str | None, list[str], dict[str, int]]:
    """(canonical form, names of the steps that changed it, counts of what was seen).

    Each kind of block is looked for in the text and in the readings of the kinds before it.
    """
    if text is None:
        return None, [], {}
    steps: dict[str, bool] = {}
    signals: Counter[str] = Counter()
    if not text.isascii():
        hidden = sum(c in INVISIBLE for c in text)
        visible = "".join(c for c in text if c not in INVISIBLE) if hidden else text
        composed = unicodedata.normalize("NFKC", visible)
        stand_ins = Counter(CHARACTERS[c][0] for c in composed if c in CHARACTERS)
        steps = {"zero_width_stripped": hidden > 0, "homoglyph_normalized": composed != visible or "homoglyph" in stand_ins, "emoji_cipher_decoded": "emoji_cipher" in stand_ins}
        signals += Counter({"zero_width_or_bidi": hidden, "homoglyph": stand_ins["homoglyph"], "emoji_cipher": stand_ins["emoji_cipher"]})
        text = "".join(CHARACTERS[c][1] if c in CHARACTERS and CHARACTERS[c][0] != "hidden" else c for c in composed) if stand_ins else composed
    for kind in KINDS:
        found = list(findings(text, kind))
        read = sum(f.reading is not None for f in found)
        signals += Counter({kind.signal: len(found)}) + Counter({kind.unread or kind.signal: len(found) - read})
        steps[kind.step] = read > 0
        text = with_readings(text, found) if read else text
    return text, [s for s, done in steps.items() if done], dict(signals)


@F.pandas_udf(SCHEMA)
def _undisguise(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([undisguised(t) for t in texts], columns=["canonical", "transforms", "signals"])


def undisguise(text: Column) -> Column:
    """struct<canonical, transforms, signals>."""
    return once(_undisguise)(text)
