"""Text functions: normal forms, kana, file names, cue lines."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no built-in for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


#: What searched texts lose: punctuation, separators, control characters and white space.
_IGNORED = r"[\p{P}\p{Z}\p{C}\s]"
#: Katakana U+30A1 to U+30F6 and the hiragana that stand 0x60 before them.
_KATAKANA = {c: c - 0x60 for c in range(0x30A1, 0x30F7)}


def stripped(text: Column) -> Column:
    """Lower case without punctuation, separators and control characters."""
    return F.regexp_replace(F.lower(text), _IGNORED, "")


def norm_text(text: Column) -> Column:
    """The form in which texts are searched: NFKC, lower case, no punctuation or space.

    Only texts beyond ASCII, which NFKC may change, go to Python, in batches of bounded size (see `small_batches`).
    """
    small_batches()
    return stripped(F.coalesce(nfkc(F.when(F.octet_length(text) > F.char_length(text), text)), text))


def small_batches() -> None:
    """Keep the active session's Arrow batches below 1,024 rows and 4 MB, as one text may be very long."""
    spark = SparkSession.getActiveSession()
    for name, most in (("maxRecordsPerBatch", 1024), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch("([0-9]+)[bB]?", spark.conf.get(key)) if spark else None
        if spark and not (now and 0 < int(now[1]) <= most):
            spark.conf.set(key, str(most))


def norm_needle(text: str) -> str:
    """The same form of a search term, made on the driver: terms are literals."""
    return regex.sub(_IGNORED, "", unicodedata.normalize("NFKC", text).lower())


def hiragana_needle(text: str) -> str:
    """Katakana of a search term as hiragana."""
    return text.translate(_KATAKANA)


def to_hiragana(text: Column) -> Column:
    """Katakana U+30A1 to U+30F6 as hiragana."""
    return F.translate(text, "".join(map(chr, _KATAKANA)), "".join(map(chr, _KATAKANA.values())))


def file_part(name: Column) -> Column:
    """A portable file-name part: reserved characters become _, spaces run together, trailing dots and spaces go."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " ")
    return F.regexp_replace(F.trim(clean), r"[. ]+$", "")


def cut_bytes(text: Column, most: int | Column) -> Column:
    """The longest start of a text of at most so many UTF-8 bytes; a character keeps its combining marks."""
    units = F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))
    start = F.struct(F.lit("").alias("t"), F.lit(True).alias("go"))

    def step(a, u):
        fits = a["go"] & (F.octet_length(a["t"]) + F.octet_length(u) <= most)
        return F.struct(F.when(fits, F.concat(a["t"], u)).otherwise(a["t"]).alias("t"), fits.alias("go"))

    return F.when(F.octet_length(text) <= most, text).otherwise(F.aggregate(units, start, step, lambda a: a["t"]))


def first_rule(text: Column, rules: list[str], group: int) -> Column:
    """The group of the first regular expression that matches; rules are data."""
    found = [F.when(text.rlike(r), F.regexp_extract(text, r, group)) for r in rules]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def split_names(names: Column, separator: str = r"[、，,・/／&＆]") -> Column:
    """Names split, trimmed, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(names, separator), lambda x: F.trim(x)), lambda x: x != ""))


#: Notes in brackets (two levels deep), whole sound lines, and a speaker label at a line's head (default rules, as data).
NOTE = r"[(（](?:[^()（）]|[(（][^()（）]*[)）])*[)）]"
SOUND_LINE = rf"^\s*(?:{NOTE}|[♪～〜]+[^()（）]*)\s*$"
LABEL = r"^\s*[(（]([^()（）]+)[)）]\s*(?=\S)"


def _depth_after(line: Column, depth: Column) -> Column:
    """How many brackets are open after a line that began with `depth` of them; closing ones too many count for nothing."""
    signs = F.regexp_extract_all(line, F.lit("[()（）]"), F.lit(0))
    return F.aggregate(signs, depth, lambda d, c: F.when(c.isin("(", "（"), d + 1).otherwise(F.greatest(d - 1, F.lit(0))))


def cue_lines(text: Column) -> Column:
    """Logical lines: a line break inside brackets, however deep or long they are, is a space and does not split."""
    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("depth"))

    def step(a, line):
        whole = F.when(a["depth"] > 0, F.concat(a["cur"], F.lit(" "), line)).otherwise(line)
        depth = _depth_after(line, a["depth"])
        ends = depth == 0
        return F.struct(F.when(ends, F.concat(a["out"], F.array(whole))).otherwise(a["out"]).alias("out"), F.when(ends, "").otherwise(whole).alias("cur"), depth.alias("depth"))

    lines = F.aggregate(F.split(text, "\n"), none, step, lambda a: F.concat(a["out"], F.array(a["cur"])))
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def classify_cue(text: Column) -> Column:
    """(kind, speakers, body, sounds, withheld) of a cue.

    A line that is only a note is a sound line; if an unlabelled line of speech follows it, its meaning is open and it is
    withheld. Speakers count only when every line of speech has a label. Bodies lose their notes.
    """
    lines = cue_lines(text)
    sound = lambda x: x.rlike(SOUND_LINE)
    labelled = lambda x: x.rlike(LABEL) & ~sound(x)
    speech = F.filter(lines, lambda x: ~sound(x))
    bodies = F.filter(F.transform(speech, lambda x: F.trim(F.regexp_replace(x, NOTE, ""))), lambda x: x != "")
    spoken = F.filter(speech, lambda x: F.trim(F.regexp_replace(x, NOTE, "")) != "")
    open_ = F.exists(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: sound(F.get(lines, i - 1)) & F.coalesce(~sound(F.get(lines, i)) & ~labelled(F.get(lines, i)), F.lit(False)))
    sounds = F.filter(F.transform(F.filter(lines, sound), lambda x: F.trim(F.regexp_replace(x, r"^\s*[(（]|[)）]\s*$", ""))), lambda x: x != "")
    names = F.flatten(F.transform(spoken, lambda x: split_names(F.regexp_extract(x, LABEL, 1))))
    every = F.forall(spoken, labelled) & (F.size(spoken) > 0)
    some = F.exists(spoken, labelled)
    kind = F.when(F.size(bodies) > 0, "line").when(F.size(lines) > 0, "sfx").otherwise("empty")
    return F.struct(
        kind.alias("kind"),
        F.when(every, F.array_distinct(names)).otherwise(F.array().cast("array<string>")).alias("speakers"),
        F.array_join(bodies, "\n").alias("body"),
        F.array_join(sounds, " / ").alias("sounds"),
        (open_ | (some & ~every)).alias("withheld"),
    )


#: Small kana that join the kana before them, and the long-vowel mark (fixed values).
_SMALL = "ゃゅょぁぃぅぇぉゎャュョァィゥェォヮ"


def morae(kana: Column) -> Column:
    """Kana split into morae: a kana with the small kana that follow it."""
    return F.regexp_extract_all(kana, F.lit(rf"[^{_SMALL}\s][{_SMALL}]*"), F.lit(0))


#: Waves that stand for a long vowel, and marks that stand for a pause (default values, as data).
TILDES, PAUSE_MARKS, LONG, PAUSE = "~〜～∼", "、。,.!?！？…‥", "ー", "、"


def spoken_text(text: Column, tildes: str = TILDES, marks: str = PAUSE_MARKS) -> Column:
    """(text, origin) of a text as it is aligned: waves are long marks, pause marks and spaces one sign, other symbols go.

    origin[i] is the place in the original of the i-th character that is left.
    """

    def spoken(c):
        wave, mark = c.isin(*tildes), c.isin(*marks) | c.rlike(r"^[\s\p{Z}]$")
        dropped = c.rlike(r"^[\p{P}\p{S}\p{Cc}\p{Cf}]$")
        return F.when(wave, LONG).when(c == LONG, c).when(mark, PAUSE).when(dropped, None).otherwise(c)

    kept = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(spoken(c).alias("c"), i.alias("i"))), lambda s: s["c"].isNotNull() & (s["c"] != ""))
    return F.struct(F.array_join(F.transform(kept, lambda s: s["c"]), "").alias("text"), F.transform(kept, lambda s: s["i"]).alias("origin"))


NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def midi_of_hz(hz: Column) -> Column:
    return F.when(hz > 0, 69 + 12 * F.log2(hz / 440.0))


def note_name(midi: Column) -> Column:
    """The nearest note: halves go up."""
    n = F.floor(midi + 0.5).cast("int")
    return F.concat(F.element_at(F.array(*map(F.lit, NOTES)), F.pmod(n, F.lit(12)) + 1), (F.floor(n / 12) - 1).cast("string"))


def midi_of_note(name: Column) -> Column:
    """Note names such as C4, F#3 and Bb2 to MIDI; null for others."""
    ok = r"^\s*([A-Ga-g])([#♯b♭]?)(-?\d+)\s*$"
    letter, mark, octave = (F.regexp_extract(name, ok, i) for i in (1, 2, 3))
    base = F.element_at(F.create_map(*(x for k, v in zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11), strict=True) for x in (F.lit(k), F.lit(v)))), F.upper(letter))
    shift = F.when(mark.isin("#", "♯"), 1).when(mark.isin("b", "♭"), -1).otherwise(0)
    return F.when(name.rlike(ok), (octave.try_cast("int") + 1) * 12 + base + shift)
