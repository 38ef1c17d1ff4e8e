"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that end a line or count as vertical space.
LINE_BREAKERS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
#: Signs stripped from the start of a line that becomes a title, and the title of a note without one.
TITLE_MARKUP = "# \n\t*`-"
UNTITLED = "Untitled"
#: Words a minute.
READING_SPEED = 213
SUMMARY_LENGTH = 700
#: White space as Python's str.split() sees it.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
#: A word that can become a tag: a letter, then letters, digits, underscores, apostrophes and hyphens.
WORD = r"[\p{L}][\p{L}\p{N}\p{M}_'’\-]*"
INLINE_TAG = r"(?U)(?<![\w/])#(\w[\w/-]*)"
#: Symbols of the category So from U+2000 on.
EMOJI = r"([\p{So}&&[^\x{0}-\x{1FFF}]])"
#: Function words and archive noise that don't become tags.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't
cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't
having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its
itself just me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't
she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there there's these they
they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what
what's when when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your
yours yourself yourselves http https www com net org html amp rt via tco x twitter status tweet tweets post posts image images video
videos
""".split()


def remove_line_breakers(text: Column) -> Column:
    return F.translate(text, LINE_BREAKERS, " " * len(LINE_BREAKERS))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def title_from_body(body: Column) -> Column:
    """The first line without leading markup; UNTITLED if nothing is left."""
    first = strip(F.split_part(strip(body), F.lit("\n"), F.lit(1)))
    title = strip(F.ltrim(first, F.lit(TITLE_MARKUP)))
    return F.when(F.coalesce(title, F.lit("")) == "", UNTITLED).otherwise(title)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def reading_minutes(text: Column) -> Column:
    """Words divided by READING_SPEED, rounded up; 0 without words."""
    return F.ceil(F.size(words(F.coalesce(text, F.lit("")))) / READING_SPEED).cast("int")


def summary(prose: Column) -> Column:
    return F.substring(F.array_join(words(prose), " "), 1, SUMMARY_LENGTH)


def word_tags(prose: Column, stop: Column | None = None, shortest: int = 3) -> Column:
    """Distinct words of at least `shortest` signs that aren't stop words, lower-cased and sorted."""
    found = F.transform(F.regexp_extract_all(prose, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.lower(F.regexp_replace(w, "^[-'’]+|[-'’]+$", "")))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS]) if stop is None else stop
    return F.array_sort(F.array_except(F.filter(F.array_distinct(found), lambda w: F.length(w) >= shortest), stop))


def explicit_tags(prose: Column, frontmatter: Column | None = None) -> Column:
    """#inline tags and the frontmatter's, lower-cased, distinct and sorted."""
    inline = F.transform(F.regexp_extract_all(prose, F.lit(INLINE_TAG), F.lit(1)), lambda t: F.lower(F.regexp_replace(t, "^[/-]+|[/-]+$", "")))
    both = inline if frontmatter is None else F.array_union(inline, frontmatter)
    return F.array_sort(F.array_distinct(F.filter(both, lambda t: t != "")))


def emoji_symbols(text: Column) -> Column:
    """Distinct emoji in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(EMOJI), F.lit(1)))


def is_emoji_term(term: Column) -> Column:
    """Nothing but emoji, joiners, selectors and modifiers, and at least one emoji."""
    return term.rlike(r"^(?:[\p{So}&&[^\x{0}-\x{1FFF}]]|\x{200D}|\x{FE0F}|\p{Sk})+$") & term.rlike(EMOJI)


def sanitised_name(name: Column, longest: int = 100) -> Column:
    """A file name: no reserved signs, single spaces, no dots or spaces at the ends, at most `longest` signs."""
    safe = F.regexp_replace(remove_line_breakers(F.coalesce(name, F.lit(""))), r'[\x00-\x1f<>:"/\\|?*#^\[\]]', " ")
    safe = F.regexp_replace(F.array_join(words(safe), " "), r"^[. ]+|[. ]+$", "")
    safe = F.regexp_replace(F.substring(safe, 1, longest), r"[. ]+$", "")
    return F.when(safe == "", UNTITLED).when(F.upper(safe).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), safe)).otherwise(safe)


def resource_links(body: Column) -> Column:
    """The ids, case kept, of links to 32 hex digits: ](:/id) and ](:/id "title")."""
    return F.regexp_extract_all(body, F.lit(r'!?\[[^\]]*\]\(:/([0-9a-fA-F]{32})(?:\s+"[^"]*")?\)'), F.lit(1))


def html_image_resources(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']?:/([0-9a-f]{32})"""), F.lit(1))


def without_title_line(body: Column, title: Column) -> Column:
    """The body without its first line where that is the title, as text or as a heading."""
    first = F.split_part(body, F.lit("\n"), F.lit(1))
    same = strip(F.regexp_replace(first, r"^\s*#+\s*", "")) == title
    return F.when(same, F.regexp_replace(F.substr(body, F.length(first) + 2), r"^[\r\n]+", "")).otherwise(body)
