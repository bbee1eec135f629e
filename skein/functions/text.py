"""Row functions on texts and labels, as native columns: nothing here leaves the JVM.

Null in, null out, unless a function says otherwise. White space is Unicode's, through an explicit class: Java's own
``\\s`` is ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the corpus rules treat as white space.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
WS_NOT_BLANK = WS.replace(r"\x{1c}-\x{20}", r"\x{1c}-\x{1f}")
#: Letters that may be alone in a run of spaced letters, symbols, sentence ends.
LETTER, SYMBOL, SYMBOL_OR_WS = r"\p{L}", r"[^\p{L}\p{N}" + WS[1:], r"[^\p{L}\p{N}]"
SENTENCE_END = "[。！？!?.]"

#: Script classes by language and the least share of letters that must be in them.
SCRIPTS = {
    "en": ["Latin"], "es": ["Latin"], "fr": ["Latin"], "de": ["Latin"], "ru": ["Cyrillic"], "ar": ["Arabic"],
    "hi": ["Devanagari"], "zh": ["Han"], "ja": ["Hiragana", "Katakana", "Han"], "ko": ["Hangul"],
}
LEAST_SCRIPT = {"zh": 0.15, "ja": 0.2, "ko": 0.2, "hi": 0.25, "ar": 0.25, "ru": 0.25}
LEAST_SCRIPT_ELSE = 0.3
#: The length classes, upper ends included.
LENGTHS = [(10, "short"), (100, "medium"), (500, "long")]
LENGTH_ELSE = "extra_long"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- tokens and lengths


def tokens(text: Column | str) -> Column:
    """Runs without white space."""
    return F.filter(F.split(as_column(text), WS + "+"), lambda t: t != "")


def token_count(text: Column | str) -> Column:
    """Number of tokens; 0 for null."""
    return F.coalesce(F.size(tokens(F.coalesce(as_column(text), F.lit("")))), F.lit(0))


def length_class(n: Column | str) -> Column:
    n = as_column(n)
    out = F.lit(LENGTH_ELSE)
    for most, name in reversed(LENGTHS):
        out = F.when(n <= most, name).otherwise(out)
    return F.when(n.isNotNull(), out)


def strip(text: Column | str) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(as_column(text), f"^{WS}+|{WS}+$", "")


def squeeze(text: Column | str) -> Column:
    """One blank for each run of white space, none at the ends."""
    # single blanks, which are most of the white space, stay as they are
    return F.regexp_replace(F.regexp_replace(as_column(text), f"{WS_NOT_BLANK}{WS}*| {WS}+", " "), "^ | $", "")


def snippet(text: Column | str, most: int = 220) -> Column:
    flat = squeeze(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("...")))


def slug(value: Column | str) -> Column:
    return F.translate(F.lower(strip(value)), " \\", "_/")


def text_key(text: Column | str) -> Column:
    """Key of the text without regard to case and white space. lower(upper(x)) stands for full case folding."""
    return F.md5(F.lower(F.upper(squeeze(text))))


def author_key(source: Column | str, author: Column | str) -> Column:
    """The same person in two sources is two authors."""
    return F.sha2(F.concat_ws(":", as_column(source), as_column(author)), 256)


def label_or_unknown(value: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(as_column(value)), F.lit("")), F.lit("unknown"))


# -- language labels and genres


def canonical_language(label: Column | str) -> Column:
    """Language part of a label, by prefix for the corpus languages; empty for null."""
    v = F.regexp_replace(F.lower(F.trim(as_column(label))), "_", "-")
    out = F.split_part(v, F.lit("-"), F.lit(1))
    for code in ("hi", "ko", "ja", "ru", "ar", "de", "fr", "es", "en", "zh"):
        out = F.when(v.startswith(code), code).otherwise(out)
    return F.coalesce(out, F.lit(""))


def primary(genre: Column | str) -> Column:
    return F.substring_index(as_column(genre), "/", 1)


def normal_genre(genre: Column | str, source: Column | str, rules: dict[str, tuple[str, str]]) -> Column:
    """Genre by the source's rule: ``fixed`` replaces it, ``under`` puts it below a primary genre; a missing one takes
    the rule's genre, or ``unknown`` where the source has no rule. Rules: source -> (kind, genre)."""
    g, source = slug(genre), as_column(source)
    g = F.when(F.coalesce(g, F.lit("")) != "", g)
    out = F.coalesce(g, F.lit("unknown"))
    for name, (kind, base) in rules.items():
        if kind == "fixed":
            made = F.lit(base)
        else:
            made = F.when(g.isNull(), base).when(g.startswith(base.split("/")[0]), g).otherwise(F.concat(F.lit(base.split("/")[0] + "/"), g))
        out = F.when(source == name, made).otherwise(out)
    return out


# -- quality


def share(count: Column, of: Column) -> Column:
    """count / of, 0 where there is nothing."""
    return F.when(of > 0, count.cast("double") / of).otherwise(F.lit(0.0))


def count_of(text: Column | str, pattern: str) -> Column:
    """Number of characters of a class. Runs are taken out whole: a match for each run, not for each character."""
    text = as_column(text)
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{pattern})+", ""))


def bind(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it. Plain column reuse would repeat the whole
    expression at every use once projections are merged."""
    return F.transform(F.array(value), f)[0]


def _unique(t: Column) -> Column:
    return share(F.size(F.array_distinct(t)), F.size(t))


def unique_token_share(text: Column | str) -> Column:
    return bind(tokens(text), _unique)


def is_shelf(source: Column | str) -> Column:
    """Public-domain shelves are told by ``pd`` in the source's name."""
    return F.coalesce(F.lower(as_column(source)).contains("pd"), F.lit(False))


def symbol_share(text: Column | str, source: Column | str) -> Column:
    """Characters that are no letter, digit or white space, over all; on shelves white space counts too."""
    n = F.when(is_shelf(source), count_of(text, SYMBOL_OR_WS)).otherwise(count_of(text, SYMBOL))
    return n.cast("double") / F.greatest(F.length(as_column(text)), F.lit(1))


def longest_run(text: Column | str, pattern: str) -> Column:
    """Length of the longest match of ``pattern``, 0 if there is none."""
    found = F.regexp_extract_all(as_column(text), F.lit(f"({pattern})"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, F.length)), F.lit(0))


def symbol_run(text: Column | str) -> Column:
    return longest_run(text, SYMBOL + "+")


def repeat_run(text: Column | str) -> Column:
    """Length of the longest run of one character that is no white space, from runs of two up."""
    runs = F.regexp_extract_all(as_column(text), F.lit(r"((" + NOT_WS + r")\2+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def dirty_reason(text: Column | str, source: Column | str, n_tokens: Column | str, unique: float = 0.2, symbols: float = 0.4, symbol_run_most: int = 5, repeat_most: int = 20) -> Column:
    """The first reason that applies, or null: zero_length, no_tokens, low_unique_ratio, high_symbol_ratio,
    long_symbol_run (shelves only), long_repeat_run. A null text has no tokens."""
    return bind(F.coalesce(as_column(text), F.lit("")), lambda x: bind(tokens(x), lambda t: _dirty(x, t, source, as_column(n_tokens), unique, symbols, symbol_run_most, repeat_most)))


def _dirty(x: Column, t: Column, source: Column | str, n: Column, unique: float = 0.2, symbols: float = 0.4, symbol_run_most: int = 5, repeat_most: int = 20) -> Column:
    return (
        F.when(n == 0, "zero_length")
        .when(F.size(t) == 0, "no_tokens")
        .when(_unique(t) < unique, "low_unique_ratio")
        .when(symbol_share(x, source) > symbols, "high_symbol_ratio")
        .when(is_shelf(source) & x.rlike(SYMBOL + "{" + str(symbol_run_most + 1) + ",}"), "long_symbol_run")
        .when(x.rlike(r"(" + NOT_WS + r")\1{" + str(repeat_most) + ",}"), "long_repeat_run")
    )


def single_letter(token: Column) -> Column:
    return token.rlike(r"^\p{L}$")


def _single_share(t: Column) -> Column:
    return share(F.size(F.filter(t, single_letter)), F.size(t))


def single_letter_share(text: Column | str) -> Column:
    return bind(tokens(text), _single_share)


def single_letter_run(text: Column | str) -> Column:
    """Longest run of tokens of one letter each."""
    return _single_run(tokens(text))


def _single_run(t: Column) -> Column:
    init = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, t: Column) -> Column:
        run = F.when(single_letter(t), acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(t, init, step, lambda acc: acc["best"])


def collapse_spaced(text: Column | str) -> Column:
    """Runs of two or more one-letter tokens become one word; the tokens are joined by single blanks, without blanks
    before ``,.;!?`` and inside round brackets. Paragraph ends vanish, as they do wherever it is applied. A blank is
    inside a run if the token on either side is one letter, so one pass finds them all."""
    flat = F.array_join(tokens(text), " ")
    flat = F.regexp_replace(flat, r"(?<=(?<![^ ])\p{L}) (?=\p{L}(?![^ ]))", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, r" +([,.;!?])", "$1"), r"\( +", "("), r" +\)", ")"))


def despaced(text: Column | str, ratio: float = 0.25, run: int = 2) -> Column:
    """The text, collapsed where its one-letter tokens call for it."""
    spaced = bind(tokens(text), lambda t: (_single_share(t) >= ratio) | (_single_run(t) >= run))
    return F.when(spaced, collapse_spaced(text)).otherwise(as_column(text))


def letter_share(text: Column | str) -> Column:
    """Letters among the characters that are no white space."""
    return share(count_of(text, LETTER), count_of(text, NOT_WS))


def _letter_tokens(t: Column) -> Column:
    return share(F.size(F.filter(t, lambda x: x.rlike(LETTER))), F.size(t))


def letter_token_share(text: Column | str) -> Column:
    return bind(tokens(text), _letter_tokens)


def script_share(text: Column | str, lang: Column | str) -> Column:
    """Share of the letters that are of the language's scripts; null for a language without scripts, 0 without
    letters."""
    text = as_column(text)
    letters = count_of(text, LETTER)
    out = F.lit(None).cast("double")
    for code, names in SCRIPTS.items():
        wanted = "[" + "".join(rf"\p{{Is{n}}}" for n in names) + "]"
        n = F.length(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}]+", ""), f"[^{wanted[1:-1]}]+", ""))
        out = F.when(as_column(lang) == code, share(n, letters)).otherwise(out)
    return out


def least_script(lang: Column | str) -> Column:
    out = F.lit(LEAST_SCRIPT_ELSE)
    for code, v in LEAST_SCRIPT.items():
        out = F.when(as_column(lang) == code, v).otherwise(out)
    return out


def untranslatable(text: Column | str, lang: Column | str, letters: float = 0.25, letter_tokens: float = 0.5, single: float = 0.45, run: int = 10) -> Column:
    """Too few letters or words, too many single letters, or a script that isn't the language's. True for null."""
    return bind(F.coalesce(as_column(text), F.lit("")), lambda x: bind(tokens(x), lambda t: _untranslatable(x, t, lang, letters, letter_tokens, single, run)))


def _untranslatable(x: Column, t: Column, lang: Column | str, letters: float = 0.25, letter_tokens: float = 0.5, single: float = 0.45, run: int = 10) -> Column:
    words = lambda w: (w == 0) | (w < letter_tokens)
    return (
        bind(_letter_tokens(t), words)
        | (letter_share(x) < letters)
        | (_single_share(t) > single)
        | (_single_run(t) >= run)
        | F.coalesce((count_of(x, LETTER) >= 8) & (script_share(x, lang) < least_script(lang)), F.lit(False))
    )


def filter_reason(text: Column | str, source: Column | str, lang: Column | str) -> Column:
    """Quality filter: the first reason to drop, or null."""

    def reason(x: Column, t: Column) -> Column:
        spaced = (_single_share(t) > 0.45) | (_single_run(t) > 10)
        return F.when(spaced, "spaced_letters").otherwise(F.coalesce(_dirty(x, t, source, F.size(t)), F.when(_untranslatable(x, t, lang), "untranslatable")))

    return bind(F.coalesce(as_column(text), F.lit("")), lambda x: bind(tokens(x), lambda t: reason(x, t)))


def surface(text: Column | str) -> list[Column]:
    """The seven surface features, named."""
    text = F.coalesce(as_column(text), F.lit(""))
    n, t = F.greatest(F.length(text), F.lit(1)), tokens(text)
    spaces = count_of(text, WS)
    return [
        F.length(text).cast("double").alias("chars"), F.size(t).cast("double").alias("tokens"), (count_of(text, SYMBOL) / n).alias("punctuation"),
        (count_of(text, r"\p{Nd}") / n).alias("digits"), (count_of(text, r"\p{Lu}") / n).alias("upper"), (spaces / n).alias("spaces"),
        share(F.length(text) - spaces, F.size(t)).alias("token_length"),
    ]


# -- segments


def paragraphs(text: Column | str) -> Column:
    """Parts between blank lines; if there is none, sentences; if there is none, the text."""
    cut = lambda t, p: F.filter(F.transform(F.split(t, p), strip), lambda x: x != "")
    parts = cut(as_column(text), r"\n[\x{9}-\x{d}\x{20}]*\n")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(text)))


def sentences(text: Column | str) -> Column:
    """Parts after a sentence end with white space, and lines; the text if there is none."""
    parts = F.filter(F.transform(F.split(as_column(text), f"(?<={SENTENCE_END}){WS}+|\n+"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(text)))


# -- cleaning of crawled text

#: Named HTML entities that occur in posts; numeric ones are handled by html_clean's Python twin.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column | str) -> Column:
    out = as_column(text)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def html_clean(text: Column | str) -> Column:
    """Post body to plain text: entities, code blocks and tags out, white space squeezed."""
    out = F.regexp_replace(unescape(text), r"(?is)<pre><code>.*?</code></pre>", " ")
    return squeeze(F.regexp_replace(out, r"(?s)<[^>]+>", " "))


def markup_clean(text: Column | str, rounds: int = 8) -> Column:
    """Wiki markup to plain text: comments, references, tags, nested templates (innermost first, ``rounds`` deep), file
    and category links, other links by their label, headings, tables and quote marks."""
    out = F.regexp_replace(as_column(text), r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<ref[^>]*/>|<ref[^>]*>.*?</ref>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for _ in range(rounds):
        out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", " ")
    out = F.regexp_replace(out, r"(?s)\{\|.*?\|\}", " ")
    out = F.regexp_replace(out, r"(?i)\[\[(?:category|file|image):[^\]]*\]\]", " ")
    out = F.regexp_replace(out, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[https?://[^\s\]]+ ?([^\]]*)\]", "$1")
    out = F.regexp_replace(out, r"(?m)^=+[ \t]*(.*?)[ \t]*=+[ \t]*$", "$1")
    return squeeze(unescape(F.regexp_replace(out, r"'{2,}", "")))


def boilerplate_strip(text: Column | str) -> Column:
    """The part between the START and END lines of a public-domain book; what lacks a mark is open on that side."""
    head = F.regexp_replace(as_column(text), r"(?is)^.*?\*\*\* ?START OF[^\n]*\*\*\*", "")
    return strip(F.regexp_replace(head, r"(?is)\*\*\* ?END OF.*$", ""))


def drop_nul(text: Column | str) -> Column:
    """Rows with a NUL character are skipped by the reader: true for those to keep."""
    return ~F.contains(as_column(text), F.lit("\x00"))


def header_value(text: Column | str, name: str) -> Column:
    """A header field of a message: looked for before the first blank line only."""
    head = F.split(as_column(text), r"\r?\n\r?\n", 2)[0]
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{name}:(.*)$", 1)), F.lit(""))


def first_author(authors: Column | str) -> Column:
    return strip(F.split_part(as_column(authors), F.lit(","), F.lit(1)))


def title_author(title: Column | str) -> Column:
    """Author in brackets at the end of a title."""
    return F.nullif(F.regexp_extract(as_column(title), r"\(([^()]+)\)[ \t]*$", 1), F.lit(""))


def keyword_genre(text: Column | str, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first genre one of whose keywords occurs in the lower-cased text."""
    low = F.lower(as_column(text))
    out = F.lit(otherwise)
    for genre, words in reversed(rules):
        out = F.when(low.rlike("|".join(words)), genre).otherwise(out)
    return out


def mapped(value: Column | str, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """Lookup in a small fixed table."""
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(as_column(value) == k, v).otherwise(out)
    return out


# -- metric names

#: Model families by name part, in order of precedence.
FAMILIES = [("tfidf", "baseline"), ("ngram", "baseline"), ("ppm", "baseline"), ("e5", "encoder"), ("bge", "encoder"), ("llama", "decoder"), ("qwen", "decoder")]


def metric_name(name: Column | str) -> Column:
    v = F.regexp_replace(F.lower(F.trim(as_column(name))), "-", "_")
    return F.when(v.startswith("eer"), "eer").otherwise(v)


def lower_is_better(name: Column | str) -> Column:
    return metric_name(name) == "eer"


def metric_task(name: Column | str) -> Column:
    return F.when(metric_name(name).isin("eer", "roc_auc"), "attribution").otherwise("representation")


def model_family(name: Column | str) -> Column:
    out = F.lit("other")
    for part, family in reversed(FAMILIES):
        out = F.when(F.lower(as_column(name)).contains(part), family).otherwise(out)
    return out


def parameters_for_humans(n: Column | str) -> Column:
    n = as_column(n)
    return F.when(n >= 1_000_000_000, F.concat(F.bround(n / 1e9, 1).cast("string"), F.lit("B"))).when(n >= 1_000_000, F.concat(F.bround(n / 1e6, 0).cast("int").cast("string"), F.lit("M"))).otherwise(n.cast("string"))


# -- portable hashing


def md5_int(value: Column, digits: int = 15) -> Column:
    """The first hex digits of md5 as a bigint: the same number in any engine."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("bigint")


def shuffle_key(seed: int | str, key: Column) -> Column:
    """Order by this for a reproducible shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def flat_values(*candidates: Column) -> Column:
    """The first of several list or text columns with something in it, lists joined by commas; blank entries don't count."""
    out = []
    for c in candidates:
        out.append(F.nullif(F.array_join(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), ", "), F.lit("")))
    return F.coalesce(*out)


def catalogue_entry(kind: Column, number: Column, languages: Column, authors: Column, wanted: list[str]) -> Column:
    """Struct (id, lang, author) of a catalogue row that is a text with a numeric id, a wanted language and an author, else
    null. Languages are cut at ``;``, the first wanted one counts; authors likewise, the first one counts."""
    parts = lambda c: F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    lang = F.get(F.filter(F.transform(parts(languages), lambda x: F.lower(x)), lambda x: x.isin(wanted)), F.lit(0))
    author = F.get(parts(authors), F.lit(0))
    ok = (F.lower(F.trim(kind)) == "text") & F.trim(number).rlike("^[0-9]+$") & lang.isNotNull() & author.isNotNull()
    return F.when(ok, F.struct(F.trim(number).alias("id"), lang.alias("lang"), author.alias("author")))
