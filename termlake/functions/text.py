"""Column functions on terms and texts.  All run inside the JVM; null in gives null out unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)[\s\x1c-\x1f]+"
#: Terms of these characters match at word boundaries, all others as plain substrings.
BOUNDARY_TERM = r"^[a-z0-9][a-z0-9 ._+/#-]*$"
CJK = r"[\u3040-\u30ff\u3400-\u9fff]"
#: What case folding changes in a text that is in lower case already, by the rule of the Unicode tables at hand.
FOLDS = {c: c.casefold() for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))) if c.lower() == c != c.casefold()}
#: Letters of any case that lower case alone does not fold, but for those of ß, which are frequent, as ranges of a pattern.
_ODD_LETTERS = [c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))) if c.lower().casefold() != c.lower() and c not in "ßẞ"]
_ODD_RANGES = "".join(c + "-" * (ord(c) + 1 == ord(n)) for c, n in zip(_ODD_LETTERS, [*_ODD_LETTERS[1:], "\0"], strict=True))
_ODD_RANGES = re.sub("(.)-(?:.-)+(.)", r"\1-\2", _ODD_RANGES)


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed once, also where fn uses it inside lambdas."""
    return F.transform(F.array(value), fn)[0]


def normalise_space(s: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(s, SPACES, " "))


def casefold(s: Column) -> Column:
    """Full case folding: lower case, and letters like ß, ﬁ or final sigma by their folded forms.

    ß is replaced wherever it stands; only texts with another letter that lower case does not fold are taken apart.
    """
    low = F.lower(s)
    table = F.create_map(*[F.lit(x) for pair in FOLDS.items() for x in pair])
    each = F.array_join(F.transform(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    odd = F.regexp_like(s, F.lit(f"[{_ODD_RANGES}Σ]"))  # capital sigma can become a final one
    return F.when(F.octet_length(s) == F.length(s), low).when(odd, each).otherwise(F.replace(low, F.lit("ß"), F.lit("ss")))


def term_key(s: Column) -> Column:
    """Without white space at the ends, case folded."""
    return casefold(F.regexp_replace(s, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))


def norm_len(s: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(s, r"(?U)\s", ""))


def quote_regex(s: Column) -> Column:
    """The text with a backslash before every character that patterns give a meaning."""
    return F.regexp_replace(s, r"([\\^$.|?*+()\[\]{}\-#/])", r"\\$1")


def contains_key(s: Column) -> Column:
    """The form in which ``source_contains`` compares texts and terms."""
    return casefold(normalise_space(s))


def is_plain(key: Column) -> Column:
    """Whether a term of this form matches at word boundaries."""
    return F.regexp_like(key, F.lit(BOUNDARY_TERM))


def key_in(text_key: Column, key: Column) -> Column:
    """``source_contains`` of texts and terms in the form of ``contains_key``."""
    bounded = F.regexp_like(text_key, F.concat(F.lit("(?<![a-z0-9])"), quote_regex(key), F.lit("(?![a-z0-9])")))
    return F.when(key == "", F.lit(False)).when(is_plain(key), bounded).otherwise(F.contains(text_key, key))


def source_contains(text: Column, term: Column) -> Column:
    """Whether the text has the term, without regard to case and spacing; plain terms need word boundaries."""
    return key_in(contains_key(text), contains_key(term))


def text_contains(text: Column, needle: Column) -> Column:
    """Case-sensitive substring after white space is normalised; an empty needle is nowhere."""
    n = normalise_space(needle)
    return (n != "") & F.contains(normalise_space(text), n)


def source_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(r"[a-zA-Z]+(?:'[a-zA-Z]+)?"), F.lit(0))


def alnum_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(r"[a-z0-9]+"), F.lit(0))


# ---------------------------------------------------------------- term maps

MARKER = "term_map:"


def parse_term_map(block: Column) -> Column:
    """array<struct<term, translation>> of the lines after the marker, split at the first '='; NONE and blanks give nothing."""
    at = F.instr(block, MARKER)
    body = F.when(at > 0, F.substr(block, at + F.lit(len(MARKER)))).otherwise(F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^=]*)=", 1)).alias("term"), F.trim(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)).alias("translation")))
    return F.filter(pairs, lambda p: (p["term"] != "") & (p["translation"] != ""))


def dedup_pairs(pairs: Column, last: bool = False) -> Column:
    """Pairs with distinct term keys: of equal keys the first stays, or the last, at the place of the first."""

    def firsts(all_pairs: Column) -> Column:
        return let(F.transform(all_pairs, lambda p: term_key(p["term"])), lambda keys: F.filter(all_pairs, lambda p, i: F.array_position(keys, term_key(p["term"])) == i + 1))

    if not last:
        return let(pairs, firsts)

    def lasts(all_pairs: Column) -> Column:
        back = F.reverse(all_pairs)
        keyed = F.struct(back.alias("back"), F.transform(back, lambda p: term_key(p["term"])).alias("keys"))
        return let(keyed, lambda z: F.transform(firsts(all_pairs), lambda p: F.element_at(z["back"], F.array_position(z["keys"], term_key(p["term"])).cast("int"))))

    return let(pairs, lasts)


def format_term_map(pairs: Column, empty: str = "omit") -> Column:
    """The block of distinct non-empty pairs; without any the empty text, or a NONE block if ``empty`` is none_block."""
    kept = F.filter(dedup_pairs(pairs), lambda p: (F.trim(p["term"]) != "") & (F.trim(p["translation"]) != ""))
    none = f"{MARKER}NONE" if empty == "none_block" else ""
    return let(
        F.transform(kept, lambda p: F.concat(F.trim(p["term"]), F.lit("="), F.trim(p["translation"]))),
        lambda lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"{MARKER}\n"), F.array_join(lines, "\n"))).otherwise(F.lit(none)),
    )


# ---------------------------------------------------------------- masks and tags


def mask_pattern(term: Column) -> Column:
    """The pattern that masks a term: plain terms at word boundaries in any case, one CJK character between others, other CJK as it is."""
    norm = normalise_space(term)
    body = F.regexp_replace(quote_regex(norm), " ", r"\\s+")
    return (
        F.when(F.regexp_like(norm, F.lit(r"^[A-Za-z0-9][A-Za-z0-9 ._+/#&%()-]*\z")), F.concat(F.lit(r"(?iU)(?<![A-Za-z0-9])"), body, F.lit(r"(?![A-Za-z0-9])")))
        .when(F.regexp_like(norm, F.lit(rf"^{CJK}\z")), F.concat(F.lit(f"(?U)(?<!{CJK})"), body, F.lit(f"(?!{CJK})")))
        .when(F.regexp_like(norm, F.lit(CJK)), F.concat(F.lit("(?U)"), body))
        .otherwise(F.concat(F.lit("(?iU)"), body))
    )


def mask_terms(text: Column, patterns: Column) -> Column:
    """struct<text, removed>: each pattern in turn is replaced by a space; order the patterns longest first."""
    start = F.struct(text.alias("text"), F.lit(0).alias("removed"))
    step = lambda acc, p: F.struct(F.regexp_replace(acc["text"], p, F.lit(" ")).alias("text"), (acc["removed"] + F.regexp_count(acc["text"], p)).alias("removed"))
    return F.aggregate(patterns, start, step, lambda acc: F.struct(normalise_space(acc["text"]).alias("text"), acc["removed"].alias("removed")))


def _tag_patterns(mode: str) -> tuple[str, str, str]:
    """Patterns of whole tags, of cut-off opening tags, and of all that goes with tags character by character."""
    if mode not in ("term", "term_t"):
        raise ValueError(f"tags to strip are term or term_t, not {mode}")
    name = "term" if mode == "term" else "(?:term|t)"
    whole, cut = rf"</?\s*{name}\s*>", r"<\s*term\b(?!\s*>)|<\s*term(?=[^\s>/])"
    after = rf"</\s*{name}\s*>\s+(?=[-,.;:!?，。；：！？)\]}}])"  # white space before a hyphen or a closing mark
    before = rf"(?<=[-(\[{{])\s+(?=<\s*{name}\s*>)"  # and after a hyphen or an opening one
    return f"(?iU){whole}", f"(?iU){cut}", f"(?iU){after}|{before}|{whole}|{cut}"


def _strip_word(word: Column, mode: str) -> Column:
    whole, cut, _ = _tag_patterns(mode)
    return F.regexp_replace(F.regexp_replace(word, whole, ""), cut, "")


def strip_output_tags(text: Column, mode: str = "term", unit: str = "char") -> Column:
    """struct<text, removed>: a text without tags, and how many were taken out.

    By ``word`` each word loses its tags, words that were tags only go, and single spaces stand between the others.  By
    ``char`` all white space stays but that between a tag and a hyphen or bracket.  Mode ``none`` changes nothing; null is empty.
    """
    text = F.coalesce(text, F.lit(""))
    if mode == "none":
        return F.struct(text.alias("text"), F.lit(0).alias("removed"))
    whole, cut, each = _tag_patterns(mode)
    if unit != "word":
        return F.struct(F.regexp_replace(text, each, "").alias("text"), (F.regexp_count(text, F.lit(whole)) + F.regexp_count(text, F.lit(cut))).alias("removed"))
    words = F.split(normalise_space(text), " ")
    one = lambda w: F.regexp_count(w, F.lit(whole)) + F.regexp_count(F.regexp_replace(w, whole, ""), F.lit(cut))
    bare = F.filter(F.transform(words, lambda w: _strip_word(w, mode)), lambda w: w != "")
    return F.struct(F.array_join(bare, " ").alias("text"), F.aggregate(words, F.lit(0), lambda n, w: n + one(w)).alias("removed"))


def strip_tag_words(words: Column, *series: Column, mode: str = "term") -> Column:
    """array<struct<word, v0, v1, ...>>: words with tags taken off; words that were tags only go, with their values."""
    zipped = F.arrays_zip(words.alias("w"), *[s.alias(f"v{i}") for i, s in enumerate(series)])
    bare = F.transform(zipped, lambda z: F.struct(_strip_word(z["w"], mode).alias("word"), *[z[f"v{i}"].alias(f"v{i}") for i in range(len(series))]))
    return F.filter(bare, lambda z: z["word"] != "")


def latency_units(text: Column, lang: Column) -> Column:
    """Units of delay: words where the language has spaces, else characters without white space."""
    spaced = ~lang.isin("zh", "ja")
    clean = normalise_space(text)
    return F.when(text.isNull(), None).when(spaced, F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))).otherwise(norm_len(text))


# ---------------------------------------------------------------- classes, keys and numbers


def term_class(term: Column) -> Column:
    """acronym_or_symbolic_name, multiword_expression or single_word_term.

    Symbolic are terms with a digit, with a token of capitals alone (digits may follow), or with a capital inside a token;
    tokens are runs of A-Z, a-z and digits.
    """
    symbolic = F.regexp_like(term, F.lit(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]|(?<![A-Za-z0-9])[A-Z]{2,}(?![A-Za-z0-9])|(?<=[A-Za-z0-9])[A-Z]"))
    tokens = F.regexp_count(term, F.lit("[A-Za-z0-9]+"))
    return F.when(symbolic, "acronym_or_symbolic_name").when(tokens >= 2, "multiword_expression").otherwise("single_word_term")


def outcome(ours: Column, base: Column) -> Column:
    return F.when(ours & base, "both_correct").when(ours & ~base, "gain").when(~ours & base, "loss").otherwise("both_wrong")


def candidate_keep_probability(supported: Column, score: Column, cuts: tuple[float, float], keep: tuple[float, float, float, float, float]) -> Column:
    """Probability to keep a candidate: supported, without score, below the first cut, below the second, above."""
    return F.when(supported, keep[0]).when(score.isNull(), keep[1]).when(score < cuts[0], keep[2]).when(score < cuts[1], keep[3]).otherwise(keep[4])


def can_count_copy(translation: Column) -> Column:
    """Copies of empty texts and of one CJK character say nothing."""
    return (F.trim(translation) != "") & ~F.regexp_like(F.trim(translation), F.lit(f"^{CJK}$"))


def normalise_term(s: Column, mode: str = "none") -> Column:
    """none, lower_strip or aggressive: in lower case, punctuation to spaces, plain plurals to singulars."""
    if mode == "none":
        return s
    if mode == "lower_strip":
        return F.lower(F.trim(s))
    words = F.filter(F.split(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, singular), " ")


def singular(w: Column) -> Column:
    """-ies to -y, -es after a hissing sound and a plain -s away; short words and -ss, -us, -is stay."""
    short = lambda n: F.substr(w, F.lit(1), F.length(w) - n)
    return (
        F.when(~w.endswith("s"), w)
        .when((F.length(w) > 4) & w.endswith("ies"), F.concat(short(3), F.lit("y")))
        .when((F.length(w) > 4) & w.endswith("es") & F.regexp_like(w, F.lit("(s|x|z|ch|sh)es$")), short(2))
        .when((F.length(w) > 3) & ~F.substr(w, F.length(w) - 1, F.lit(2)).isin("ss", "us", "is"), short(1))
        .otherwise(w)
    )


def match_words(s: Column) -> Column:
    """The words of ``match_tokens`` of any number, by patterns over the whole text: without 's and other characters, singular."""
    line = F.lower(normalise_space(s))
    line = F.regexp_replace(F.regexp_replace(line, "'s(?= |$)", ""), "[^a-z0-9' ]", "")
    # patterns begin with the letters to go, so that only words that end in them are looked at, and then backwards
    end, sibilant = "(?![^ ])", "[a-z0-9'](?:[a-z0-9'][sxz]|[cs]h)es"  # a word of five letters or more
    # plain plurals first, but not words that the rules after take
    line = F.regexp_replace(line, f"s{end}(?<=[a-z0-9']{{2}}[a-z0-9'&&[^sui]]s)(?<![a-z0-9']{{2}}ies)(?<!{sibilant})", "")
    line = F.regexp_replace(line, f"ies{end}(?<=[a-z0-9']{{2}}ies)", "y")
    line = F.regexp_replace(line, f"es{end}(?<={sibilant})", "")
    return F.array_remove(F.split(line, " "), "")


def match_tokens(s: Column, most: int = 8) -> Column:
    """Normalised words of a term; null if there are none or more than ``most``."""
    words = match_words(s)
    return F.when((F.size(words) > 0) & (F.size(words) <= most), words)


def speech_group_key(utterance: Column, chunk: Column, path: Column) -> Column:
    u, p = F.coalesce(utterance, F.lit("")), F.coalesce(path, F.lit(""))
    return F.when((u != "") & chunk.isNotNull(), F.concat(u, F.lit("::"), chunk.cast("string"))).when(p != "", F.concat(F.lit("path::"), p)).otherwise(F.lit(""))


UNIT = 0.96


def multiplier(duration: Column, unit: float = UNIT, mode: str = "round") -> Column:
    x = duration / F.lit(unit)
    return F.greatest(F.lit(1), (F.ceil(x) if mode == "ceil" else F.bround(x)).cast("int"))


def recall_k(duration: Column, density: int = 10, by: str = "multiplier") -> Column:
    return (multiplier(duration) * density).cast("int") if by == "multiplier" else F.ceil(duration * F.lit(density)).cast("int")


def map_cap(mult: Column, coefficient: float, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(1), F.bround(F.lit(coefficient) * mult).cast("int")))


def seconds_to_chunks(seconds: Column, lm: Column, up: bool = True) -> Column:
    x = F.round(seconds / (F.lit(UNIT) * lm), 9)
    return F.greatest(F.lit(1), (F.ceil(x) if up else F.floor(x)).cast("int"))


def duration_tag(seconds: Column) -> Column:
    return F.regexp_replace(F.format_string("%.2f", seconds.cast("double")), r"\.", "p")


def nearest_duration(seconds: Column, known: list[float], tolerance: float = 0.05) -> Column:
    best = F.array_min(F.array(*[F.struct(F.abs(seconds - k).alias("d"), F.lit(k).alias("k")) for k in known]))
    return F.when(best["d"] <= tolerance, duration_tag(best["k"])).otherwise(F.concat(F.lit("unknown:"), F.format_string("%.2f", seconds.cast("double"))))


def centered_start(middle: Column, width: float, total: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(middle - width / 2, total - width))


def covering_start(start: Column, end: Column, width: float, total: Column) -> Column:
    """Start of a window that holds the span if it fits, as central as the ends allow."""
    free = F.greatest(F.lit(0.0), F.least((start + end) / 2 - width / 2, total - width))
    return F.when(end - start > width, F.greatest(F.lit(0.0), start)).otherwise(F.greatest(F.lit(0.0), F.least(F.greatest(free, end - width), start)))


def clipped_span(start: Column, end: Column, window_start: Column, window_end: Column) -> Column:
    """The span inside a window, relative to its start; null if nothing is left."""
    a, b = F.greatest(start, window_start) - window_start, F.least(end, window_end) - window_start
    return F.when(b > a, F.struct(a.alias("start"), b.alias("end")))


def stable_draw(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 13 hex digits of sha256 over the parts, joined by U+001F."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def stable_uint64(*parts: Column) -> Column:
    """The first 64 bits of the same sha256, as decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_id63(*parts: Column) -> Column:
    """A non-negative 63-bit id that is never 0."""
    h = F.xxhash64(F.concat_ws("\x1f", *[p.cast("string") for p in parts])).bitwiseAND(F.lit(2**63 - 1))
    return F.when(h == 0, F.lit(1)).otherwise(h)


def valid_term(s: Column, most_words: int = 5, stop: tuple[str, ...] = ()) -> Column:
    """Terms of 3 to 60 characters, letters first, few words, no brackets, not all stop words."""
    words = F.split(F.lower(normalise_space(s)), " ")
    ok = F.length(s).between(3, 60) & F.regexp_like(s, F.lit(r"^\p{L}")) & ~F.regexp_like(s, F.lit(r"[()\[\]{}:;]")) & (F.size(words) <= most_words)
    return ok & (F.size(F.array_except(words, F.array(*[F.lit(w) for w in stop]).cast("array<string>"))) > 0)


def description_echo(description: Column, key: Column) -> Column:
    """Whether a description says no more than its key."""
    return F.trim(F.replace(F.replace(F.lower(description), F.lower(key), F.lit("")), F.lit(","), F.lit(""))) == ""


def trivial_match(a: Column, b: Column) -> Column:
    """Whether one text has the other inside, in lower case and without punctuation and spaces."""
    x, y = (F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "") for c in (a, b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def length_ratio_ok(a: Column, b: Column, low: float = 0.5, high: float = 2.0) -> Column:
    return (F.length(a) > 0) & (F.length(b) / F.length(a)).between(low, high)


def script_share(s: Column, pattern: str = CJK) -> Column:
    return F.when(F.length(s) > 0, F.regexp_count(s, F.lit(pattern)) / F.length(s)).otherwise(F.lit(0.0))


def split_chunks(s: Column, size: int) -> Column:
    """Paragraphs packed greedily into chunks of at most ``size`` characters; longer paragraphs stand alone."""
    paragraphs = F.filter(F.split(s, "\n"), lambda p: F.trim(p) != "")
    empty = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(p) <= size)
        return F.when(fits, F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.concat(last, F.lit("\n"), p))).otherwise(F.array_append(acc, p))

    return F.aggregate(paragraphs, empty, step)


def sample_evenly(chunks: Column, most: int) -> Column:
    """At most ``most`` items at even distances, the first always."""
    return F.when(F.size(chunks) <= most, chunks).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(chunks, (F.floor(i * F.size(chunks) / most) + 1).cast("int"))))


def parse_json_array(s: Column, schema: str) -> Column:
    """The first bracketed array of a text that may fence it."""
    return F.from_json(F.regexp_extract(s, r"(?s)(\[.*\])", 1), schema)


def scrub_paths(s: Column, prefixes: dict[str, str]) -> Column:
    """Path prefixes replaced, the longest first."""
    for old in sorted(prefixes, key=len, reverse=True):
        s = F.replace(s, F.lit(old), F.lit(prefixes[old]))
    return s


def path_stem(s: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(s, r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", "")


def audio_field(s: Column) -> Column:
    """struct<path, start, end> of ``path:offset:length``, cut from the right."""
    p = lambda k: F.regexp_extract(s, r"^(.*):(\d+):(\d+)$", k)
    return F.when(F.regexp_like(s, F.lit(r"^(.*):(\d+):(\d+)$")), F.struct(p(1).alias("path"), p(2).cast("long").alias("start"), (p(2).cast("long") + p(3).cast("long")).alias("end")))


def metric_line(s: Column, name: str) -> Column:
    """The number after a metric's name."""
    return F.regexp_extract(s, rf"{name}\s*[=:]?\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def tag_value(tags: Column, prefix: str) -> Column:
    """The value of the first ``prefix:value`` of an array of tags."""
    return F.regexp_replace(F.get(F.filter(tags, lambda t: t.startswith(f"{prefix}:")), F.lit(0)), f"^{prefix}:", "")


def truncate(s: Column, size: int, mark: str = "...") -> Column:
    return F.when(F.length(s) > size, F.concat(F.substring(s, 1, size), F.lit(mark))).otherwise(s)


def safe_tag(s: Column) -> Column:
    return F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_")


def find_spans(tokens: Column, needle: Column) -> Column:
    """Starts (from 0) of all places where the needle's tokens stand in a row."""

    def spans(z: Column) -> Column:
        n, k = F.size(z["t"]), F.size(z["x"])
        every = F.when((k > 0) & (n >= k), F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda i: (F.element_at(z["t"], i + 1) == F.element_at(z["x"], 1)) & (F.slice(z["t"], i + 1, k) == z["x"]))

    return let(F.struct(tokens.alias("t"), needle.alias("x")), spans)


def find_token_spans(tokens: Column, needle: Column) -> Column:
    """array<struct<start, end>> of token runs equal to the needle; failing that, single tokens that contain a one-token needle."""

    def spans(z: Column) -> Column:
        lower, small = z["t"], z["x"]
        one = F.element_at(small, 1)

        def pick(whole: Column) -> Column:
            inner = F.filter(F.transform(lower, lambda t, i: F.when(F.contains(t, one), F.struct(i.alias("start"), (i + 1).alias("end")))), lambda x: x.isNotNull())
            return F.when((F.size(whole) > 0) | (F.size(small) != 1), whole).otherwise(inner)

        found = let(F.transform(find_spans(lower, small), lambda i: F.struct(i.alias("start"), (i + F.size(small)).alias("end"))), pick)
        return F.when(F.size(small) > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    return let(F.struct(F.transform(tokens, F.lower).alias("t"), F.transform(needle, F.lower).alias("x")), spans)


def parse_number(s: Column) -> Column:
    """Metrics of result tables: empty, NA and N/A are null."""
    return F.when(F.trim(s).isin("", "NA", "N/A"), None).otherwise(F.trim(s).try_cast("double"))


def format_metric(x: Column, digits: int = 4, signed: bool = False) -> Column:
    """The number with so many decimals, rounded by its exact binary value (exact ties to even); null gives NA.

    Formatting rounds by the shortest decimal form, which may look like a tie where the number is none: there the exact
    sign of x * 2 * 10**digits - odd number decides, from two products without rounding error.
    """
    x, scale = x.cast("double"), float(2 * 10**digits)
    odd = F.round(x * scale)
    tie = (F.abs(x * scale - odd) < 1e-3) & (F.pmod(odd, F.lit(2.0)) == 1) & (F.abs(odd) < 2.0**50)
    high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of the digits
    over = (high * scale - odd) + (x - high) * scale
    up = (over > 0) | ((over == 0) & (F.pmod(odd, F.lit(4.0)) == 3))
    shown = F.when(tie, (odd + F.when(up, 1).otherwise(-1)) / scale).otherwise(x)
    return F.coalesce(F.format_string(f"%{'+' if signed else ''}.{digits}f", shown), F.lit("NA"))


def pick_spans(spans: Column) -> Column:
    """Of overlapping spans (structs with start and end) the earliest stays, of equal starts the longest."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), (-s["end"].cast("long")).alias("back"))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, s: Column) -> Column:
        free = (F.size(acc) == 0) | (s["start"] >= F.element_at(acc, -1)["end"])
        return F.when(free, F.array_append(acc, F.struct(s["start"].alias("start"), (-s["back"]).alias("end")))).otherwise(acc)

    return F.aggregate(ordered, empty, step)


def char_spans(s: Column, term: Column, least: int = 3) -> Column:
    """array<struct<start, end>> of all places of a term at word boundaries, in any case; terms below ``least`` characters have none."""
    lower, t = F.lower(s), F.lower(normalise_space(term))

    def places(z: Column) -> Column:
        n = F.length(z["t"])
        every = F.when((n >= least) & (F.length(z["s"]) >= n), F.sequence(F.lit(0), F.length(z["s"]) - n)).otherwise(F.array().cast("array<int>"))
        inside = lambda i: F.regexp_like(F.substr(z["s"], i, F.lit(1)), F.lit("[a-z0-9]"))
        hits = F.filter(every, lambda i: (F.substr(z["s"], i + 1, n) == z["t"]) & ~((i > 0) & inside(i)) & ~inside(i + n + 1))
        return F.transform(hits, lambda i: F.struct(i.alias("start"), (i + n).alias("end")))

    return let(F.struct(lower.alias("s"), t.alias("t")), places)
