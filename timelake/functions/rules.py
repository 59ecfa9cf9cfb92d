"""Rules as data: ordered regular expressions with named groups, and the rules by which cues are told apart.

A rule list is checked once, when it is stored; then it is a column expression. Named groups are written (?P<name>...) or
(?<name>...); rules run on the JVM, so they are checked there, and recursion is no part of them: brackets of any depth are
read by `bracketed` instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from timelake.functions.text import cue_lines

#: Bounds of a stored rule list, and seconds that a rule may take on a sample.
MOST_RULES, MOST_CHARS, SECONDS = 32, 2000, 0.5
#: Texts that make careless rules slow: a part, how often, an end.
STRESS = [("a", 100_000, "!"), ("（あ", 200, ""), ("（a）", 500, ""), ("[x] ", 2000, "-"), (" - ", 3000, "9")]


class RuleError(ValueError):
    """A rule that is not accepted: `reason` and its 1-based `place` in the list."""

    def __init__(self, reason: str, place: int, detail: str = ""):
        super().__init__(f"rule {place}: {reason} {detail}".rstrip())
        self.reason, self.place = reason, place


def _java(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


def checked(rules: list[str], groups: tuple[str, ...], required: tuple[str, ...] = (), samples: tuple[str, ...] = (), spark: SparkSession | None = None) -> tuple[str, ...]:
    """The list, if each rule is a text of bounded length that compiles, has the required groups and one of `groups`, and is quick on
    samples; else a RuleError (too-many, not-text, too-long, syntax, missing-group, timeout)."""
    if len(rules) > MOST_RULES:
        raise RuleError("too-many", MOST_RULES + 1)
    for place, rule in enumerate(rules, 1):
        if not isinstance(rule, str) or not rule:
            raise RuleError("not-text", place)
        if len(rule) > MOST_CHARS:
            raise RuleError("too-long", place)
        try:
            compiled = regex.compile(rule)
            if "(?&" in rule or "(?R)" in rule:
                raise regex.error("recursion")
            if spark is not None:
                spark.sparkContext._jvm.java.util.regex.Pattern.compile(_java(rule))
        except Exception as e:
            raise RuleError("syntax", place, str(e).splitlines()[0]) from None
        names = set(compiled.groupindex)
        if any(g not in names for g in required) or groups and not names & set(groups):
            raise RuleError("missing-group", place)
        for text in (*samples, *(part * times + end for part, times, end in STRESS)):
            try:
                compiled.search(text, timeout=SECONDS)
            except TimeoutError:
                raise RuleError("timeout", place) from None
    return tuple(rules)


def first_match(text: Column, rules: tuple[str, ...], groups: tuple[str, ...]) -> Column:
    """(groups..., rule): what the first rule that is found in the text gives for each group (trimmed, null if blank or not in the
    rule), and its place from 0; null if none is found."""
    found = []
    for place, rule in enumerate(rules):
        at = regex.compile(rule).groupindex
        part = lambda g: F.nullif(F.trim(F.regexp_extract(text, _java(rule), at[g])), F.lit("")) if g in at else F.lit(None).cast("string")  # noqa: B023, E731
        found.append(F.when(text.rlike(_java(rule)), F.struct(*(part(g).alias(g) for g in groups), F.lit(place).alias("rule"))))
    empty = F.lit(None).cast("struct<" + ", ".join(f"{g}:string" for g in groups) + ", rule:int>")
    return F.coalesce(*found, empty)


def work_and_episode(name: Column, rules: tuple[str, ...]) -> Column:
    """(work, episode, rule) of a file's name without extension; without a match the episode is the name itself."""
    m = first_match(name, rules, ("work", "episode"))
    return F.struct(m["work"].alias("work"), F.coalesce(m["episode"], name).alias("episode"), m["rule"].alias("rule"))


def bracketed(line: Column) -> Column:
    """(body, notes, labels): a line without its notes in round brackets, their contents at any depth, and those at its head.

    A closing bracket without an opening one is text; so is all from the outermost opening bracket that is never closed.
    """
    signs = F.regexp_extract_all(line, F.lit("[^()（）]+|[()（）]"), F.lit(0))
    none = F.array().cast("array<string>")
    state = lambda depth, body, cur, opened, notes, labels: F.struct(depth.alias("depth"), body.alias("body"), cur.alias("cur"), opened.alias("opened"), notes.alias("notes"), labels.alias("labels"))

    def step(a, t):
        inside, outer = a["depth"] > 0, a["depth"] <= 1
        opening = state(a["depth"] + 1, a["body"], F.when(inside, F.concat(a["cur"], t)).otherwise(""), F.when(inside, a["opened"]).otherwise(t), a["notes"], a["labels"])
        head = F.trim(a["body"]) == ""
        note = state(F.lit(0), a["body"], F.lit(""), F.lit(""), F.concat(a["notes"], F.array(a["cur"])), F.when(head, F.concat(a["labels"], F.array(a["cur"]))).otherwise(a["labels"]))
        deeper = state(a["depth"] - 1, a["body"], F.concat(a["cur"], t), a["opened"], a["notes"], a["labels"])
        plain = state(a["depth"], F.when(inside, a["body"]).otherwise(F.concat(a["body"], t)), F.when(inside, F.concat(a["cur"], t)).otherwise(a["cur"]), a["opened"], a["notes"], a["labels"])
        closing = t.isin(")", "）")
        return F.when(t.isin("(", "（"), opening).when(closing & inside & outer, note).when(closing & inside, deeper).otherwise(plain)

    start = state(F.lit(0), F.lit(""), F.lit(""), F.lit(""), none, none)
    done = lambda a: F.struct(F.when(a["depth"] > 0, F.concat(a["body"], a["opened"], a["cur"])).otherwise(a["body"]).alias("body"), a["notes"].alias("notes"), a["labels"].alias("labels"))
    return F.aggregate(signs, start, step, done)


@dataclass(frozen=True)
class CueRules:
    """How cues are read: what separates names, which signs begin a sound line that has no brackets, and how sounds are joined."""

    separators: str = "、，,・/／&＆"
    music: str = "♪～〜"
    joiner: str = " / "


def classify_text(text: Column, rules: CueRules = CueRules()) -> Column:
    """(kind, speakers, body, sounds, withheld) of a cue of any number of lines and depth of brackets.

    A line of notes alone (or one that begins with a sign of music) is a sound line. If a line of speech without a label follows
    it, it may be a name that stands alone: then nothing is taken from it, and the cue is withheld. Notes at a line's head are
    its labels; readings in brackets inside them are no part of the name. Speakers count when all lines of speech have
    labels; if some have, the cue is withheld. kind: line, sfx or empty.
    """
    music = rf"^[{regex.escape(rules.music, literal_spaces=True)}]" if rules.music else None

    def read(x):
        b = bracketed(x)
        body = F.trim(b["body"])
        quiet = (body == "") & (F.size(b["notes"]) > 0)
        sound = quiet | body.rlike(music) if music else quiet
        return F.struct(sound.alias("sound"), body.alias("body"), b["notes"].alias("notes"), F.when(sound, F.array().cast("array<string>")).otherwise(b["labels"]).alias("labels"), x.alias("line"))

    lines = F.transform(cue_lines(text), read)

    def judged(ls):
        after = lambda i: F.get(ls, i + 1)
        lone = lambda i: F.coalesce(~after(i)["sound"] & (F.size(after(i)["labels"]) == 0), F.lit(False))
        marked = F.transform(ls, lambda s, i: F.struct(s["sound"].alias("sound"), (s["sound"] & lone(i)).alias("lone"), s["body"].alias("body"), s["notes"].alias("notes"), s["labels"].alias("labels"), s["line"].alias("line")))
        heard = F.filter(marked, lambda s: s["sound"] & ~s["lone"])
        named = F.transform(heard, lambda s: F.when(F.size(s["notes"]) > 0, s["notes"]).otherwise(F.array(F.trim(s["line"]))))
        sounds = F.filter(F.transform(F.flatten(named), lambda x: F.trim(x)), lambda x: x != "")
        speech = F.filter(marked, lambda s: ~s["sound"] & (s["body"] != ""))
        has = lambda s: F.size(s["labels"]) > 0
        split = lambda n: F.filter(F.transform(F.split(bracketed(n)["body"], f"[{regex.escape(rules.separators, literal_spaces=True)}]"), lambda y: F.trim(y)), lambda y: y != "")
        names = F.array_distinct(F.flatten(F.transform(speech, lambda s: F.flatten(F.transform(s["labels"], split)))))
        every, some = F.forall(speech, has) & (F.size(speech) > 0), F.exists(speech, has)
        kind = F.when(F.size(ls) == 0, "empty").when((F.size(speech) == 0) & ((F.size(sounds) > 0) | F.forall(ls, lambda s: s["sound"])), "sfx").otherwise("line")
        return F.struct(kind.alias("kind"), F.when(every, names).otherwise(F.array().cast("array<string>")).alias("speakers"), F.array_join(F.transform(speech, lambda s: s["body"]), "\n").alias("body"), F.array_join(sounds, rules.joiner).alias("sounds"), (F.exists(marked, lambda s: s["lone"]) | (some & ~every)).alias("withheld"))

    return F.get(F.transform(F.array(lines), judged), F.lit(0))
