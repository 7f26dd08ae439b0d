"""Text normalisers and string functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Apostrophe variants; IPA letters folded, and marks dropped, before scoring.
APOSTROPHES = "\u0092’‘"
IPA_FROM, IPA_TO = "ẽĩõũɝ", "eiouɚ"
IPA_DROP = "\u035c\u0361\u02c8\u02cc\u0303" + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Runs of all but ASCII letters, digits and apostrophes. The JVM finds these ranges many times as fast as a class "all but".
NOT_SIMPLE = r"[\x00-&(-/:-@\[-`{-\x{10FFFF}]+"
#: IPA letters and the ASCII that stands for them.
IPA_ASCII = ("ɑɔɜɪʊʌɛ", "aoeiuue")
#: Symbols of an IPA transcript after normalisation, and the vowels among them.
IPA_SYMBOLS = " bcdfghjklmnprstvwxzeiouɑæɐɔəɚɛɪʊʌçðŋɟɫɬɹɾʁʃʒʔʝθχʧʤː"
IPA_VOWELS = "eiouɑæɐɔəɚɛɪʊʌ"


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends; Unicode spaces count."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_apostrophe(c: Column) -> Column:
    return collapse(F.translate(c, APOSTROPHES, "'" * len(APOSTROPHES)))


def norm_simple(c: Column) -> Column:
    """Curly quotes straight, all but ASCII letters, digits and apostrophes to spaces, lower case."""
    straight = F.replace(F.replace(c, F.lit("’"), F.lit("'")), F.lit("‘"), F.lit("'"))
    return F.trim(F.lower(F.regexp_replace(straight, NOT_SIMPLE, " ")))


def norm_word_ctc(c: Column) -> Column:
    """Lower case, straight apostrophes, only a-z, apostrophe and space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), "’‘", "''"), "[^a-z' ]", " "), " +", " "))


def norm_native_ctc(c: Column) -> Column:
    """Upper case, only A-Z, space and apostrophe."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z' ]", ""), " +", " "))


def norm_word_char(c: Column) -> Column:
    """Lower case; other white space to a space, other characters dropped; runs are kept."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[\t\n\x0b\f\r]", " "), "[^a-z' ]", "")


def norm_ipa(c: Column) -> Column:
    """Scoring form of an IPA transcript whose letters are already composed (see kernels.nfc for the rest)."""
    folded = F.translate(c, IPA_FROM + IPA_DROP, IPA_TO)
    return collapse(F.replace(F.replace(folded, F.lit("tʃ"), F.lit("ʧ")), F.lit("dʒ"), F.lit("ʤ")))


def norm_ipa_submit(c: Column) -> Column:
    """Submission form: r and a become their IPA letters, symbols outside the set go."""
    joined = F.replace(F.replace(F.translate(c, "ɝ", "ɚ"), F.lit("tʃ"), F.lit("ʧ")), F.lit("dʒ"), F.lit("ʤ"))
    return F.regexp_replace(collapse(F.translate(joined, "ra", "ɹɑ")), f"[^{IPA_SYMBOLS}]", "")


def has_invalid_ipa(c: Column) -> Column:
    return ~norm_ipa(c).rlike(f"^[{IPA_SYMBOLS}]*$")


def ipa_to_ascii(c: Column) -> Column:
    return F.translate(c, *IPA_ASCII)


def has_ipa(c: Column) -> Column:
    return c.rlike(f"[{IPA_ASCII[0]}]")


def manifest_text(c: Column) -> Column:
    """A bar between spaces is a separator, not a word."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit(" | "), F.lit(" ")), " +", " "))


def words(c: Column) -> Column:
    """Words between single spaces; no words for an empty text."""
    return F.filter(F.split(c, " ", -1), lambda w: w != "")


def squash_repeats(c: Column) -> Column:
    """Any pattern four times or more in a row to one."""
    return F.regexp_replace(c, r"(.+?)\1{3,}", "$1")


def dedup_adjacent(c: Column) -> Column:
    """Equal neighbours to one, in texts of three characters or more."""
    return F.when(F.length(c) >= 3, F.regexp_replace(c, r"(?s)(.)\1+", "$1")).otherwise(c)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "run").otherwise(s)


def canonical_language(c: Column) -> Column:
    s = F.trim(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**31 - 1)))


def after_tag(c: Column, tag: str = "<asr_text>") -> Column:
    """What follows the first tag; the whole text without one."""
    at = F.instr(c, tag)
    return F.when(at > 0, F.substring(c, at + len(tag), F.lit(2**31 - 1))).otherwise(c)


def parse_tagged(c: Column) -> Column:
    """'language X<asr_text>t' as a struct; no language where it says None, and the text alone without a tag."""
    parts = F.split(c, "<asr_text>", 2)
    head, rest = F.trim(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))
    language = F.when(F.lower(head).startswith("language "), F.trim(F.substring(head, 10, 2**31 - 1)))
    language = F.when(F.lower(language) == "none", F.lit("")).otherwise(language)
    return F.when(rest.isNull(), F.struct(F.lit("").alias("language"), F.trim(c).alias("text"))).otherwise(F.struct(F.coalesce(language, F.lit("")).alias("language"), F.trim(rest).alias("text")))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://[^/\s]+"), F.lit(False))


def is_base64_audio(c: Column) -> Column:
    return c.startswith("data:audio") | ((F.length(c) > 256) & ~c.contains("/") & ~c.contains("\\"))


def parent_id(c: Column) -> Column:
    return F.regexp_replace(c, "_[^_]*$", "")


def truncate_ratio(c: Column, ratio: float) -> Column:
    """The first share of a text's words, at least one; of its characters if it is one word."""
    w = words(c)
    n = F.greatest(F.lit(1), F.floor(F.size(w) * F.lit(ratio)).cast("int"))
    chars = F.greatest(F.lit(1), F.floor(F.length(c) * F.lit(ratio)).cast("int"))
    return F.when(F.size(w) > 1, F.array_join(F.slice(w, F.lit(1), n), " ")).otherwise(F.substring(c, F.lit(1), chars))


def pieces(c: Column, size: int, least: int | None = None) -> Column:
    """A text's pieces of so many characters, numbered from 0; an empty or null text has none.

    With ``least``, pieces after the first that are shorter than that go; without it, nothing is lost.
    """
    parts = F.when(F.length(c) > 0, F.sequence(F.lit(0).cast("long"), F.ceil(F.length(c) / F.lit(float(size))) - 1))
    cut = F.transform(parts, lambda i: F.struct(i.alias("part"), F.substr(c, (1 + size * i).cast("int"), F.lit(size)).alias("piece")))
    return cut if least is None else F.filter(cut, lambda p: (p["part"] == 0) | (F.length(p["piece"]) >= least))


def tokens(c: Column) -> Column:
    """Phone tokens: long vowels as one, any other character as one."""
    return F.regexp_extract_all(c, F.lit("iː|aː|uː|(?s)."), F.lit(0))


def cjk_tokens(c: Column) -> Column:
    """CJK characters one by one; runs of letters, digits and apostrophes whole."""
    return F.regexp_extract_all(c, F.lit(r"[一-鿿]|[\p{L}\p{N}'&&[^一-鿿]]+"), F.lit(0))


def text_features(c: Column) -> dict[str, Column]:
    """Shape of a text: lengths, distinct characters, entropy of characters (natural log), longest run of one."""
    w = words(c)
    lengths = F.transform(w, F.length)
    chars = F.split(c, "", -1)
    chars = F.filter(chars, lambda x: x != "")
    n = F.size(chars)
    share = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return {
        "text_len": F.length(c),
        "n_words": F.size(w),
        "mean_word_len": F.when(F.size(w) > 0, F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / F.size(w)).otherwise(0.0),
        "max_word_len": F.coalesce(F.array_max(lengths), F.lit(0)),
        "min_word_len": F.coalesce(F.array_min(lengths), F.lit(0)),
        "n_unique_chars": F.size(F.array_distinct(chars)),
        "char_entropy": F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log(p + 1e-12))).otherwise(0.0),
    }


def ipa_features(c: Column) -> dict[str, Column]:
    vowels = F.length(F.regexp_replace(c, f"[^{IPA_VOWELS}]", ""))
    letters = F.length(F.regexp_replace(c, "[ ː]", ""))
    return {"n_vowels": vowels, "n_consonants": letters - vowels, "vowel_ratio": F.when(letters > 0, vowels / letters).otherwise(0.0), "n_long": F.length(F.regexp_replace(c, "[^ː]", ""))}
