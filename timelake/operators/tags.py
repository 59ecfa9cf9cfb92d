"""Tags: boolean expressions, facets, effective tags by interval overlap, and their counts."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelake.functions.clocks import to_local, to_source
from timelake.operators.intervals import overlap_join

#: The mark of lines that several speakers share (a fixed value).
SEVERAL = "speaker-status:多人未分段"
MAX_CHARS, MAX_TERMS = 8192, 256
PROVENANCE = ("local", "source", "segment", "auto")
_TOKEN = re.compile(r'\s+|(?P<open>\()|(?P<close>\))|(?P<quoted>"(?:[^"\\]|\\.)*"?)|(?P<word>[^\s()"]+)')


class TagExprError(ValueError):
    """A malformed expression: `reason` and the 1-based character `position`."""

    def __init__(self, reason: str, position: int):
        super().__init__(f"{reason} at {position}")
        self.reason, self.position = reason, position


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind = m.lastgroup
        if kind == "quoted":
            raw = m[0]
            if len(raw) < 2 or not raw.endswith('"'):
                raise TagExprError("unclosed-quote", at + 1)
            try:
                value = json.loads(raw)
            except ValueError as e:
                raise TagExprError("bad-escape", at + 1) from e
            if not value:
                raise TagExprError("empty-tag", at + 1)
            out.append(("term", value, at + 1))
        elif kind == "word":
            word = m[0].upper()
            out.append((word if word in ("AND", "OR", "NOT") else "term", m[0], at + 1))
        elif kind:
            out.append((kind, m[0], at + 1))
        at = m.end()
    return [*out, ("end", "", len(text) + 1)]


def parse_tag_expr(text: str) -> tuple | None:
    """The expression as nested tuples: ("term", tag), ("not", x), ("and", x, y), ("or", x, y); None for the empty one."""
    if len(text) > MAX_CHARS:
        raise TagExprError("expr-too-long", MAX_CHARS + 1)
    tokens, at, terms = _tokens(text), 0, 0

    def unit() -> tuple:
        nonlocal at, terms
        kind, value, place = tokens[at]
        if kind == "NOT":
            at += 1
            return ("not", unit())
        if kind == "open":
            at += 1
            if tokens[at][0] == "close":
                raise TagExprError("empty-group", tokens[at][2])
            inner = either()
            if tokens[at][0] != "close":
                raise TagExprError("unclosed-group" if tokens[at][0] == "end" else "expect-operator", tokens[at][2])
            at += 1
            return inner
        if kind != "term":
            raise TagExprError("expect-term", place)
        at, terms = at + 1, terms + 1
        if terms > MAX_TERMS:
            raise TagExprError("too-many-terms", place)
        return ("term", value)

    def chain(word: str, part) -> tuple:
        nonlocal at
        found = part()
        while tokens[at][0] == word:
            at += 1
            found = (word.lower(), found, part())
        return found

    def both() -> tuple:
        return chain("AND", unit)

    def either() -> tuple:
        return chain("OR", both)

    if tokens[0][0] == "end":
        return None
    out = either()
    if tokens[at][0] != "end":
        raise TagExprError("unexpected-close" if tokens[at][0] == "close" else "expect-operator", tokens[at][2])
    return out


def _prefix(value: str) -> str | None:
    """The prefix that a term such as `ns:*` stands for."""
    return value[:-1] if value.endswith(":*") and len(value) > 2 else None


def tag_expr(text: str, tags: Column) -> Column:
    """A predicate over an array of tags: NOT binds tighter than AND, AND than OR; `ns:*` is a prefix; nothing is implied.

    The empty expression holds for every row. A null array counts as no tags.
    """
    tags = F.coalesce(tags, F.array().cast("array<string>"))

    def column(node: tuple) -> Column:
        if node[0] == "term":
            prefix = _prefix(node[1])
            return F.array_contains(tags, node[1]) if prefix is None else F.exists(tags, lambda t: t.startswith(prefix))
        parts = [column(n) for n in node[1:]]
        return ~parts[0] if node[0] == "not" else parts[0] & parts[1] if node[0] == "and" else parts[0] | parts[1]

    parsed = parse_tag_expr(text)
    return F.lit(True) if parsed is None else column(parsed)


def tags_match(parsed: tuple | None, tags) -> bool:
    """The same predicate on a collection of tags, for code outside of column expressions."""
    if parsed is None:
        return True
    kind, *rest = parsed
    if kind == "term":
        prefix = _prefix(rest[0])
        return rest[0] in tags if prefix is None else any(t.startswith(prefix) for t in tags)
    if kind == "not":
        return not tags_match(rest[0], tags)
    return all(tags_match(x, tags) for x in rest) if kind == "and" else any(tags_match(x, tags) for x in rest)


def facet_of(tag: Column) -> Column:
    """The namespace before the first colon; tags without one belong to the facet `tag`."""
    return F.when(F.instr(tag, ":") > 1, F.split_part(tag, F.lit(":"), F.lit(1))).otherwise("tag")


def value_of(tag: Column) -> Column:
    return F.when(F.instr(tag, ":") > 1, F.regexp_replace(tag, "^[^:]+:", "")).otherwise(tag)


def speaker_tags(names: Column) -> Column:
    """One speaker gives character:n; several give participants:n each and one mark that they are several."""
    many = F.concat(F.transform(names, lambda n: F.concat(F.lit("participants:"), n)), F.array(F.lit(SEVERAL)))
    return F.when(F.size(names) == 1, F.transform(names, lambda n: F.concat(F.lit("character:"), n))).when(F.size(names) > 1, many).otherwise(F.array().cast("array<string>"))


def tag_sets(etags: DataFrame) -> DataFrame:
    """(sample_id, tags): each sample's set of tags."""
    return etags.groupBy("sample_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def filter_by_tag_expr(samples: DataFrame, etags: DataFrame, text: str) -> DataFrame:
    """Samples whose tags satisfy the expression; samples without tags take part."""
    sets = tag_sets(etags)
    return samples.join(sets, samples["id"] == sets["sample_id"], "left").where(tag_expr(text, F.col("tags"))).drop("sample_id", "tags")


def filter_facets(samples: DataFrame, etags: DataFrame, facets: dict[str, list[str]], single: bool = False) -> DataFrame:
    """AND across facets, OR inside one. `person` matches character: and participants:, or character: alone if `single`."""
    for facet, values in facets.items():
        spaces = (["character"] if single else ["character", "participants"]) if facet == "person" else [facet]
        wanted = etags.where(F.col("tag").isin([f"{s}:{v}" for s in spaces for v in values])).select("sample_id")
        samples = samples.join(wanted, samples["id"] == wanted["sample_id"], "left_semi")
    return samples


def effective_tags(samples: DataFrame, sources: DataFrame, local: DataFrame, ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """(sample_id, tag, facet, provenance): each tag of a sample once, by its best provenance.

    samples: id, source_id, start, end, voiced; sources: source_id, work, source_type; local: sample_id, tag;
    ranges: id, source_id, start, end, tags; segments: id, source_id, start, end, speakers. Ranges and speakers of
    segments are inherited where they overlap the sample; speakers only on voiced samples.
    """
    own = local.select("sample_id", "tag", F.lit(0).alias("prio"))
    src = samples.join(sources, "source_id")
    named = [src.where(F.col(c) != "").select(F.col("id").alias("sample_id"), F.concat(F.lit(p), F.col(c)).alias("tag"), F.lit(1).alias("prio")) for c, p in (("work", "work:"), ("source_type", "type:"))]
    windows = samples.select("id", "source_id", "start", "end", "voiced")
    spans = ranges.select("source_id", "start", "end", "tags", F.lit(False).alias("speech")).union(segments.select("source_id", "start", "end", speaker_tags(F.col("speakers")).alias("tags"), F.lit(True).alias("speech")))
    inherited = overlap_join(windows, spans.where(F.size("tags") > 0)).where(~F.col("r_speech") | F.col("voiced")).select(F.col("id").alias("sample_id"), F.explode("r_tags").alias("tag"), F.lit(2).alias("prio"))
    every = reduce(DataFrame.union, [own, *named, inherited])
    best = every.groupBy("sample_id", "tag").agg(F.min("prio").alias("prio"))
    return best.select("sample_id", "tag", facet_of(F.col("tag")).alias("facet"), F.element_at(F.array(*map(F.lit, PROVENANCE)), F.col("prio") + 1).alias("provenance"))


def window_tags(windows: DataFrame, assets: DataFrame, roles: DataFrame, sources: DataFrame, ranges: DataFrame, segments: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """(id, tag, facet, provenance, ref): each tag of a window of an asset once, by its best provenance and the first to give it.

    windows: id, asset_id, start, end (the asset's clock), judge_start, judge_end (the source's clock; null: the window
    through the asset's mapping). assets: asset_id, source_id, mapping, origin, target (the note a flattened sound was
    made for). roles: asset_id, role, those that are on. sources: source_id, work, source_type. ranges: id, source_id,
    scope (source, role or asset), scope_role, scope_asset_id, start, end, tags. segments: id, source_id, start, end,
    speakers. local: id, tag. Ranges of a source hold for all its assets, those of a role for assets with the role, those
    of an asset for it alone, on its own clock. Speakers count for assets with the vocal role.
    """
    w = windows.join(assets, "asset_id")
    judged = F.col("judge_start").isNotNull() & F.col("judge_end").isNotNull()
    mapping = F.col("mapping")
    w = w.withColumns({"s0": F.when(judged, F.col("judge_start")).otherwise(to_source(mapping, F.col("start"))), "s1": F.when(judged, F.col("judge_end")).otherwise(to_source(mapping, F.col("end")))})
    first, last = mapping[0]["source"], F.element_at(mapping, -1)["source"]
    w = w.withColumns({"l0": F.coalesce(to_local(mapping, F.greatest("s0", first)), "start"), "l1": F.coalesce(to_local(mapping, F.least("s1", last)), "end")})
    give = lambda df, tag, ref, prio, order: df.select("id", tag.alias("tag"), F.struct(F.lit(prio).alias("prio"), *order, ref.cast("string").alias("ref")).alias("by"))
    zero = [F.lit(0).alias("after"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")]
    named = w.join(sources, "source_id")
    found = [give(named.where(F.col(c) != ""), F.concat(F.lit(p), F.col(c)), F.col("source_id"), 1, zero) for c, p in (("work", "work:"), ("source_type", "type:"))]
    found.append(give(w.where((F.col("origin") == "flatten") & (F.col("target") != "")), F.concat(F.lit("pitch:"), F.col("target")), F.col("asset_id"), 3, zero))
    if local is not None:
        found.append(give(local.join(windows.select("id"), "id", "left_semi"), F.col("tag"), F.lit(None), 0, zero))
    on_source = w.select("id", "asset_id", "source_id", F.col("s0").alias("start"), F.col("s1").alias("end")).where("start is not null and end is not null")
    span = ranges.where(F.size("tags") > 0).select("id", "source_id", "scope", "scope_role", "scope_asset_id", "start", "end", "tags")
    hit = overlap_join(on_source, span.where("scope <> 'asset'").drop("scope_asset_id"))
    has = roles.select("asset_id", F.col("role").alias("r_scope_role"))
    inherited = hit.where("r_scope = 'source'").select("id", "r_id", "r_tags").union(hit.where("r_scope = 'role'").join(has, ["asset_id", "r_scope_role"], "left_semi").select("id", "r_id", "r_tags"))
    on_asset = w.select("id", "asset_id", F.col("l0").alias("start"), F.col("l1").alias("end"))
    own = span.where("scope = 'asset'").select("id", F.col("scope_asset_id").alias("asset_id"), "start", "end", "tags")
    inherited = inherited.union(overlap_join(on_asset, own, "asset_id").select("id", "r_id", "r_tags"))
    found.append(give(inherited.select("id", "r_id", F.explode("r_tags").alias("t")), F.col("t"), F.col("r_id"), 2, zero))
    voices = on_source.join(roles.where("role = 'vocal'").select("asset_id"), "asset_id", "left_semi")
    said = overlap_join(voices, segments.select("id", "source_id", "start", "end", "speakers").where(F.size("speakers") > 0), eps=0.0)
    said = said.select("id", "r_id", "r_start", "r_end", F.explode(speaker_tags(F.col("r_speakers"))).alias("t"))
    found.append(give(said, F.col("t"), F.col("r_id"), 2, [F.lit(1).alias("after"), F.col("r_start").cast("double").alias("a"), F.col("r_end").cast("double").alias("b")]))
    every = reduce(DataFrame.union, found)
    best = every.groupBy("id", "tag").agg(F.min("by").alias("by"))
    return best.select("id", "tag", facet_of(F.col("tag")).alias("facet"), F.element_at(F.array(*map(F.lit, PROVENANCE)), F.col("by.prio") + 1).alias("provenance"), F.col("by.ref").alias("ref"))


def facet_counts(etags: DataFrame) -> DataFrame:
    """(facet, value, n, n_single): samples by facet value; persons are merged over both namespaces, n_single counts character: alone.

    etags hold a sample's tag once, so only a person in both namespaces is to be counted once: it is counted as a
    character, and again as a participant only where it is no character. One sum, without a distinct.
    """
    person = F.col("facet").isin("character", "participants")
    rows = etags.select("sample_id", F.when(person, "person").otherwise(F.col("facet")).alias("facet"), value_of(F.col("tag")).alias("value"), (F.col("facet") != "participants").alias("single"))
    people = rows.where("facet = 'person'").groupBy("sample_id", "facet", "value").agg(F.max("single").alias("single"))
    every = rows.where("facet <> 'person'").unionByName(people)
    return every.groupBy("facet", "value").agg(F.count("*").alias("n"), F.sum(F.col("single").cast("long")).alias("n_single"))


def tag_usage(holders: dict[str, DataFrame]) -> DataFrame:
    """(tag, one count a holder): how often each holder (a table with a column tag) has each tag."""
    rows = reduce(DataFrame.union, [df.select("tag", F.lit(name).alias("holder")) for name, df in holders.items()])
    return rows.groupBy("tag").agg(*(F.sum((F.col("holder") == name).cast("long")).alias(f"n_{name}") for name in holders))


def tags_of(etags: DataFrame, selection: DataFrame) -> DataFrame:
    """(tag, n_local, n_inherited) over a selection of samples."""
    chosen = etags.join(selection.select(F.col("id").alias("sample_id")).distinct(), "sample_id", "left_semi")
    local = F.col("provenance") == "local"
    return chosen.groupBy("tag").agg(F.count_distinct(F.when(local, F.col("sample_id"))).alias("n_local"), F.count_distinct(F.when(~local, F.col("sample_id"))).alias("n_inherited"))


def edit_tags(df: DataFrame, add: list[str], remove: list[str], tags: str = "tags") -> DataFrame:
    """Rows whose tags change, with the new tags in `new_tags`: removed ones go, added ones follow in order, once."""
    kept = F.filter(tags, lambda t: ~t.isin(remove)) if remove else F.col(tags)
    new = F.array_distinct(F.concat(kept, F.array(*map(F.lit, add)))) if add else kept
    return df.withColumn("new_tags", new).where(~F.col("new_tags").eqNullSafe(F.col(tags)))


def rename_tag(df: DataFrame, old: str, new: str | None, tags: str = "tags") -> DataFrame:
    """Rows that hold `old`, with it renamed (once each, in place) or, if `new` is None, removed."""
    changed = F.array_remove(tags, old) if new is None else F.array_distinct(F.transform(tags, lambda t: F.when(t == old, new).otherwise(t)))
    return df.where(F.array_contains(tags, old)).withColumn("new_tags", changed)


def promote(samples: DataFrame, local: DataFrame, tag: str) -> DataFrame:
    """Range tags (id, source_id, start, end, tags) that a sample's local tag becomes."""
    return samples.join(local.where(F.col("tag") == tag).select(F.col("sample_id").alias("id")), "id", "left_semi").select("id", "source_id", "start", "end", F.array(F.lit(tag)).alias("tags"))


def solo_character(blocks: DataFrame, spans: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(id, character): the character of a block, if its tags name exactly one and nobody else; else null.

    spans: source_id, start, end, tag (range tags on the block's clock); given: id, tag (the sample's own tags, and those
    of the speakers of the segment that produced the block). Only character: tags of ranges and samples count, but
    participants: among the given ones leave it open who speaks.
    """
    hit = overlap_join(blocks.select("id", "source_id", "start", "end"), spans.where(F.col("tag").startswith("character:"))).select("id", F.col("r_tag").alias("tag"))
    if given is not None:
        hit = hit.union(given.where(F.col("tag").startswith("character:") | F.col("tag").startswith("participants:")).select("id", "tag"))
    named = hit.groupBy("id").agg(F.collect_set("tag").alias("t"))
    only = F.when((F.size("t") == 1) & F.col("t")[0].startswith("character:"), F.substring(F.col("t")[0], 11, 1 << 20))
    return blocks.select("id").join(named, "id", "left").select("id", only.alias("character"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")
