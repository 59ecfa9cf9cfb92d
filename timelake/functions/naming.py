"""Names: notes with cents, targets set by hand, sample names, and names of parts of a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelake.functions.clocks import clock_label, file_clock_label
from timelake.functions.text import cut_bytes, midi_of_hz, midi_of_note, nfc, note_name

NAME_MAX = 500
_PAUSE, _GEMINATE, _NASAL = "pau", "cl", "N"


def cents_name(midi: Column) -> Column:
    """The nearest note, with the cents that a pitch lies off it."""
    n = F.floor(midi + 0.5)
    cents = F.floor((midi - n) * 100 + 0.5).cast("int")
    return F.concat(note_name(n.cast("double")), F.when(cents == 0, "").otherwise(F.format_string("%+dc", cents)))


def manual_target(text: Column) -> Column:
    """(midi, name, hz, error) of a note name (whole semitone) or a frequency with its unit (not snapped).

    Errors: target-empty, bare-number (its meaning is open), target-unparsable; notes lie between MIDI 0 and 127.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    number = r"^[+-]?(?:\d+\.?\d*|\.\d+)$"
    hz = F.when(t.rlike(r"(?i)^\d+(?:\.\d+)?\s*hz$"), F.regexp_extract(t, r"(?i)^(\d+(?:\.\d+)?)", 1).try_cast("double"))
    note = midi_of_note(t).cast("double")
    note = F.when(note.between(0, 127), note)
    midi = F.when(hz > 0, midi_of_hz(hz)).otherwise(note)
    error = F.when(t == "", "target-empty").when(t.rlike(number), "bare-number").when(midi.isNull(), "target-unparsable")
    ok = error.isNull()
    return F.struct(F.when(ok, midi).alias("midi"), F.when(ok, cents_name(midi)).alias("name"), F.when(ok, F.coalesce(hz, 440.0 * F.pow(F.lit(2.0), (midi - 69) / 12))).alias("hz"), error.alias("error"))


def suggest_name(aligned_text: Column, aligned_kana: Column, texts: Column, source_name: Column, start: Column, end: Column, mapped: Column, local_mark: Column) -> Column:
    """The first that there is: the aligned text with its kana, the overlapping texts joined, or the source with its times."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    text, kana = blank(aligned_text), blank(aligned_kana)
    lines = F.array_distinct(F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), blank), lambda x: x != ""))
    times = F.concat(clock_label(start), F.lit("–"), clock_label(end))
    place = F.when(mapped, F.concat(source_name, F.lit(" "), times)).otherwise(F.concat(source_name, F.lit(" · "), local_mark, times))
    return F.when(text != "", F.when(kana != "", F.concat(text, F.lit(" — "), kana)).otherwise(text)).when(F.size(lines) > 0, F.array_join(lines, " / ")).otherwise(place)


def romaji(labels: Column) -> Column:
    """Phone labels as letters: pauses go, a geminate takes the first letter of the consonant after it, N is n."""
    seq = F.filter(labels, lambda x: x != _PAUSE)

    def letter(x, i):
        after = F.get(seq, i + 1)
        consonant = after.isNotNull() & ~F.lower(after).isin(*"aeiou") & ~after.isin(_NASAL, _GEMINATE)
        return F.when(x == _GEMINATE, F.when(consonant, F.lower(F.substring(after, 1, 1))).otherwise("")).when(x == _NASAL, "n").otherwise(F.lower(x))

    return F.array_join(F.transform(seq, letter), "")


def partial_fragments(selections: DataFrame, phones: DataFrame, words: DataFrame, morae: DataFrame) -> DataFrame:
    """(id, segment_id, fragment, whole): what a selection holds of each segment that it touches.

    selections: id, segment_id, start, end; phones: segment_id, idx, label, start, end, mora, word; words: segment_id, word,
    text; morae: segment_id, mora, kana. A phone counts if its middle is inside. A whole word gives its text, a whole mora of
    another its kana, the rest letters. Segments of which nothing is inside have no row; whole ones an empty fragment.
    """
    speech = phones.where(F.col("label") != _PAUSE)
    sel = selections.select("id", "segment_id", F.col("start").alias("s0"), F.col("end").alias("s1"))
    middle = (F.col("start") + F.col("end")) / 2
    rows = speech.join(sel, "segment_id").withColumn("inside", (middle >= F.col("s0")) & (middle < F.col("s1")))
    w = Window.partitionBy("id", "segment_id").orderBy("idx")
    new = lambda c: (~F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(False))).cast("int")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_w", new("word")).withColumn("wrun", F.sum("_w").over(upto)).withColumn("_m", F.when(F.col("_w") == 1, 1).otherwise(new("mora"))).withColumn("mrun", F.sum("_m").over(upto))
    per_mora = rows.groupBy("id", "segment_id", "wrun", "mrun").agg(F.first("word").alias("word"), F.first("mora").alias("mora"), F.count("*").alias("n"), F.sum(F.col("inside").cast("int")).alias("got"), F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct("idx", "label")))).alias("labels"))
    named = per_mora.join(morae, ["segment_id", "mora"], "left")
    piece = F.when(F.col("got") == 0, "").when((F.col("got") == F.col("n")) & (F.coalesce("kana", F.lit("")) != ""), F.col("kana")).otherwise(romaji(F.transform("labels", lambda s: s["label"])))
    per_word = named.groupBy("id", "segment_id", "wrun").agg(F.first("word").alias("word"), F.sum("n").alias("n"), F.sum("got").alias("got"), F.array_sort(F.collect_list(F.struct("mrun", piece.alias("piece")))).alias("pieces"))
    texts = per_word.join(words.select("segment_id", "word", F.trim("text").alias("text")), ["segment_id", "word"], "left")
    part = F.when(F.col("got") == 0, "").when((F.col("got") == F.col("n")) & (F.coalesce("text", F.lit("")) != ""), F.col("text")).otherwise(F.array_join(F.transform("pieces", lambda s: s["piece"]), ""))
    g = texts.groupBy("id", "segment_id").agg(F.sum("n").alias("n"), F.sum("got").alias("got"), F.array_sort(F.collect_list(F.struct("wrun", part.alias("part")))).alias("parts"))
    whole = F.col("got") == F.col("n")
    return g.where("got > 0").select("id", "segment_id", F.when(whole, "").otherwise(F.trim(F.array_join(F.transform("parts", lambda s: s["part"]), ""))).alias("fragment"), whole.alias("whole"))


def partial_name(fragment: Column, text: Column) -> Column:
    """The selected part with its whole text in full-width brackets, which is cut where the name would be too long."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    room = NAME_MAX - F.length(fragment) - 2
    cut = F.when(F.length(flat) > room, F.concat(F.substring(flat, F.lit(1), F.greatest(room - 1, F.lit(0))), F.lit("…"))).otherwise(flat)
    return F.when(room < 1, F.substring(fragment, 1, NAME_MAX)).otherwise(F.concat(fragment, F.lit("（"), cut, F.lit("）")))


def partial_names(selections: DataFrame, segments: DataFrame, phones: DataFrame, words: DataFrame, morae: DataFrame) -> DataFrame:
    """(id, name): names of selections that hold a part of their segments; whole selections have none.

    segments: segment_id, ordinal, text. Segments that are wholly inside give their text.
    """
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    got = partial_fragments(selections, phones, words, morae)
    touched = selections.select("id", "segment_id").join(segments.select("segment_id", "ordinal", flat.alias("text")), "segment_id").join(got, ["id", "segment_id"], "left")
    piece = F.when(F.coalesce("whole", F.lit(False)), F.col("text")).otherwise(F.coalesce("fragment", F.lit("")))
    g = touched.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "segment_id", "text", piece.alias("piece")))).alias("s"), F.min(F.coalesce("whole", F.lit(True))).alias("whole"))
    fragment = F.trim(F.array_join(F.transform("s", lambda x: x["piece"]), ""))
    text = F.array_join(F.array_distinct(F.transform("s", lambda x: x["text"])), " / ")
    return g.where(~F.col("whole") & (fragment != "")).select("id", partial_name(fragment, text).alias("name"))


#: Fixed values of exported file names: what parts them, and the most UTF-8 bytes of the whole and of its parts.
BETWEEN, NAME_BYTES = "__", 255
CONTENT_BYTES, PROCESSING_BYTES, SOURCE_BYTES, KEY_CHARS, ID_CHARS = 72, 45, 35, 12, 8
_RESERVED = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\..*)?$"


def _edges(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ .]+|[ .]+$", "")


def portable(text: Column) -> Column:
    """A text as part of a file name anywhere: signs that some system forbids become _, names that one reserves get a _ before them."""
    clean = _edges(F.regexp_replace(nfc(text), r'[\\/:*?"<>|\x00-\x1f\x7f]', "_"))
    return F.when(clean.rlike(_RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)


def with_export_name(df: DataFrame, out: str = "export") -> DataFrame:
    """`df` with (name, error): the file name of an export, of at most 255 bytes.

    Columns: content, processing (may be empty), track, source, source_id, start, end, local (a word for times that are not the
    source's, or null), key (hexadecimal), ext. If the whole is too long, the content gives way first, then the track. Errors:
    export-key-invalid, time-out-of-range, filename-too-long.
    """
    fit = lambda c, most: _edges(cut_bytes(portable(F.coalesce(F.col(c), F.lit(""))), most))
    parts = df.withColumns({"_c": fit("content", CONTENT_BYTES), "_p": fit("processing", PROCESSING_BYTES), "_s": fit("source", SOURCE_BYTES), "_i": portable(F.substring("source_id", 1, ID_CHARS)), "_t": portable(F.col("track")), "_l": portable(F.coalesce("local", F.lit(""))), "_e": portable(F.col("ext")), "_k": F.substring("key", 1, KEY_CHARS)})
    times = F.concat("_l", file_clock_label(F.col("start")), F.lit("-"), file_clock_label(F.col("end")))
    tail = F.concat(F.lit(BETWEEN), "_s", F.lit(BETWEEN), "_i", F.lit("_"), times, F.lit(BETWEEN), "_k", F.lit("."), "_e")
    parts = parts.withColumn("_tail", tail)
    middle = F.when(F.col("_p") != "", F.concat(F.lit(BETWEEN), F.col("_p"))).otherwise("")
    whole = lambda c, t: F.concat(c, middle, F.lit(BETWEEN), t, F.col("_tail"))
    shorter = lambda c, name: F.when(F.octet_length(name) > NAME_BYTES, _edges(cut_bytes(c, F.greatest(F.lit(0), F.octet_length(c) - (F.octet_length(name) - NAME_BYTES))))).otherwise(c)
    parts = parts.withColumn("_c", shorter(F.col("_c"), whole(F.col("_c"), F.col("_t"))))
    parts = parts.withColumn("_t", shorter(F.col("_t"), whole(F.col("_c"), F.col("_t"))))
    name = whole(F.col("_c"), F.col("_t"))
    error = F.when(~F.col("_k").rlike(f"^[0-9a-zA-Z]{{{KEY_CHARS}}}$"), "export-key-invalid").when((F.col("start") < 0) | (F.col("end") < 0), "time-out-of-range").when(F.octet_length(name) > NAME_BYTES, "filename-too-long")
    return parts.withColumn(out, F.struct(F.when(error.isNull(), name).alias("name"), error.alias("error"))).select(*df.columns, out)
