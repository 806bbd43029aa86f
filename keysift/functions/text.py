"""Text functions as Column expressions: normalisation, query variants, n-gram candidates, collection tags, paths."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no candidates by themselves.
STOPWORDS = (
    "ai", "bi", "biet", "cach", "cac", "cho", "co", "cua", "duoc", "gi", "hay", "khong", "la", "lai", "lam", "mot",
    "nao", "nhu", "nhung", "phan", "sao", "the", "theo", "tim", "toi", "va", "ve", "vi", "voi", "please", "find",
    "search", "show", "a", "an",
)
# Tokens that no clean-up touches.
PROTECTED = ("ai", "iot", "sql", "html", "css", "python", "clip", "bus", "glass")
# Keyboard sequences of unfinished Vietnamese input, in the order in which they are replaced.
TELEX = (("dd", "d"), ("aw", "a"), ("aa", "a"), ("ee", "e"), ("oo", "o"), ("ow", "o"), ("uw", "u"))

MAX_CANDIDATES = 32


def fold(text: str) -> str:
    """Case folded, without accents; what :func:`normalize` does in a plan."""
    decomposed = unicodedata.normalize("NFD", text.casefold().replace("đ", "d"))
    return "".join(c for c in decomposed if unicodedata.category(c) != "Mn")


def _foldings() -> tuple[str, str, list[tuple[str, str]]]:
    """Of all characters that fold to letters or digits of ASCII: those of one, with what they fold to, and those of more."""
    single, target, several = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        folded = fold(chr(code))
        if folded and folded != chr(code) and all(c.isascii() and c.isalnum() for c in folded):
            if len(folded) == 1:
                single.append(chr(code)), target.append(folded)
            else:
                several.append((chr(code), folded))
    return "".join(single), "".join(target), several


_SINGLE, _TARGET, _SEVERAL = _foldings()


def normalize(text: Column) -> Column:
    """Lower case without accents: runs of a-z and 0-9 joined by single spaces."""
    lowered = F.lower(text)
    long = lowered
    for c, folded in _SEVERAL:
        long = F.replace(long, F.lit(c), F.lit(folded))
    out = F.when(lowered.rlike("[" + "".join(c for c, _ in _SEVERAL) + "]"), long).otherwise(lowered)  # few texts have one of these
    out = F.regexp_replace(F.translate(out, _SINGLE, _TARGET), r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


# The same readings of one text in a task, where a plan's expressions would be evaluated a token at a time.


class _Plain(dict):
    """What :func:`normalize` makes of each character of a lowered text, kept once met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isascii():
            out = c if c.isalnum() else " "
        else:
            out = _FOLDED.get(c) or ("" if unicodedata.category(c) == "Mn" else " ")
        self[code] = out
        return out


_FOLDED = dict(zip(_SINGLE, _TARGET)) | dict(_SEVERAL)
_PLAIN = _Plain()


# A text within Latin-1 is read as its bytes: a table for all characters that fold to one, a replacement for each other.
_LATIN = bytes(ord(p) if len(p := _PLAIN[code]) == 1 else code for code in range(256))
_LATIN_LONG = [(bytes([code]), _PLAIN[code].encode()) for code in range(256) if len(_PLAIN[code]) != 1]


def words(text: str) -> list[bytes]:
    """The tokens of :func:`plain` of one text, as bytes of ASCII."""
    lowered = text.lower()
    try:
        raw = lowered.encode("latin-1")
    except UnicodeEncodeError:
        return lowered.translate(_PLAIN).encode("ascii").split()
    if not lowered.isascii():
        for c, folded in _LATIN_LONG:
            raw = raw.replace(c, folded)
    return raw.translate(_LATIN).split()


def plain(text: str) -> str:
    """:func:`normalize` of one text."""
    return b" ".join(words(text)).decode("ascii")


_WORD_DIGITS = re.compile(r"\b([a-z]+)\d+\b")
_DOUBLED = re.compile(r"[a-z]*([a-z])\1").fullmatch
_TONE = re.compile("[a-z]{3,}[sfrxj]").fullmatch
_TYPED = re.compile("|".join(x for x, _ in TELEX)).search


def _single_final(t: str) -> str:
    return t[:-1] if len(t) >= 3 and t not in PROTECTED and _DOUBLED(t) else t


def _without_tone(t: str) -> str:
    return t[:-1] if t not in PROTECTED and _TONE(t) else t


def _meant(t: str) -> str:
    if t in PROTECTED or not _TYPED(t):
        return t
    out = t[:-1] if t[-1] in "sfrxj" else t
    for typed, meant in TELEX:
        out = out.replace(typed, meant)
    return out


def _readings(normalized: str) -> Iterator[str]:
    yield normalized
    yield _WORD_DIGITS.sub(r"\1", normalized)
    words = normalized.split()
    for change in (_single_final, _without_tone, _meant):
        yield " ".join([change(t) for t in words])


_STOP = frozenset(STOPWORDS)


def phrases(normalized: str, most: int = MAX_CANDIDATES) -> list[str]:
    """:func:`candidates` of the :func:`variants` of one normalised text; no reading is made once there are enough."""
    out: dict[str, None] = {}
    for v in _readings(normalized):
        if not v:
            continue
        words = v.split()
        out[v] = None
        for size in (3, 2):
            for i in range(len(words) - size + 1):
                run = words[i : i + size]
                if not _STOP.issuperset(run):
                    out[" ".join(run)] = None
                if len(out) >= most:
                    return list(out)[:most]  # the reading itself may have been the last
        for t in words:
            if len(t) > 1 and t not in _STOP:
                out[t] = None
        if len(out) >= most:
            break
    return list(out)[:most]


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(normalized: Column) -> Column:
    """The tokens of a normalised text in order; none of an empty one."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether a normalised text has a normalised phrase as whole tokens; an empty phrase is in none."""
    return (phrase != "") & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def _each(normalized: Column, change) -> Column:
    return F.array_join(F.transform(tokens(normalized), change), " ")


def _free(token: Column) -> Column:
    return ~token.isin(*PROTECTED)


def drop_word_digits(normalized: Column) -> Column:
    return F.regexp_replace(normalized, r"\b([a-z]+)\d+\b", "$1")


def single_final_letter(normalized: Column) -> Column:
    """Without the second of two equal letters at the end of a word of three or more."""
    doubled = lambda t: (F.length(t) >= 3) & t.rlike(r"^[a-z]*([a-z])\1$")
    return _each(normalized, lambda t: F.when(_free(t) & doubled(t), F.regexp_replace(t, ".$", "")).otherwise(t))


def drop_tone_letter(normalized: Column) -> Column:
    return _each(normalized, lambda t: F.when(_free(t) & t.rlike("^[a-z]{3,}[sfrxj]$"), F.regexp_replace(t, ".$", "")).otherwise(t))


def resolve_telex(normalized: Column) -> Column:
    def change(t: Column) -> Column:
        out = F.regexp_replace(t, "[sfrxj]$", "")
        for typed, meant in TELEX:
            out = F.replace(out, F.lit(typed), F.lit(meant))
        return F.when(_free(t) & t.rlike("|".join(x for x, _ in TELEX)), out).otherwise(t)

    return _each(normalized, change)


def variants(normalized: Column) -> Column:
    """The text and its repaired readings, each once, without empty ones."""

    def readings(n: Column) -> Column:
        return F.array(n, drop_word_digits(n), single_final_letter(n), drop_tone_letter(n), resolve_telex(n))

    return F.array_distinct(F.filter(let(normalized, readings), lambda v: v != ""))


def _ngrams(words: Column, size: int) -> Column:
    """Runs of ``size`` words that aren't all stop words, joined by spaces."""
    at = lambda i, k: F.get(words, i + k)
    starts = F.transform(words, lambda t, i: i)
    whole = F.filter(starts, lambda i: (i + size <= F.size(words)) & ~functools.reduce(Column.__and__, [at(i, k).isin(*STOPWORDS) for k in range(size)]))
    return F.transform(whole, lambda i: F.concat_ws(" ", *[at(i, k) for k in range(size)]))


def candidates(variant_list: Column, most: int = MAX_CANDIDATES) -> Column:
    """The phrases that a query is matched by: of each variant itself, its 3-grams, 2-grams and words, each once, the first ``most``."""

    def of(v: Column) -> Column:
        def phrases(words: Column) -> Column:
            single = F.filter(words, lambda t: ~t.isin(*STOPWORDS) & (F.length(t) > 1))
            return F.concat(F.array(v), _ngrams(words, 3), _ngrams(words, 2), single)

        return let(tokens(v), phrases)

    return F.slice(F.array_distinct(F.flatten(F.transform(variant_list, of))), 1, most)


def collection_tags(query: Column) -> Column:
    """The collection ids tagged in a query, in upper case and order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(r"(?i)#(L\d+)\b"), F.lit(1)), F.upper))


def untagged(query: Column) -> Column:
    """The query without tags and without the mark before other words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(query, r"(?i)#L\d+\b", " "), r"#(?=\w)", ""), r"\s+", " "))


def safe_path(path: Column) -> Column:
    """A relative path with forward slashes; null if a part of it leads upwards."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    return F.when(~F.array_contains(F.split(clean, "/"), ".."), clean)


def frame_id(video: Column, number: Column) -> Column:
    return F.format_string("%s_%06d", video, number)


def collection_of(video: Column) -> Column:
    """What stands before the first ``_V`` of a video id; null where there is none."""
    return F.when(F.instr(video, "_V") > 0, F.substring_index(video, "_V", 1))


def number_of(frame: Column) -> Column:
    """The number after the last ``_`` of a frame id; null where there is none."""
    return F.substring_index(frame, "_", -1).try_cast("int")
