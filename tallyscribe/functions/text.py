"""Text-cleaning expressions and the word lists and patterns they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cleaning patterns (java.util.regex syntax) and characters.
MENTION = r"(?U)@\p{Graph}*"
TAG = r"(?U)<\p{Graph}*>"
BROKEN_APOSTROPHE = "â€™"
STRAY_CHARACTERS = "ðŸ€™â¤£˜ªï"
URL = r"(s?)(f|ht)tp(s?)://\S*[\p{L}\p{N}_]"
PICTURE_LINK = r"pic.twitter.com/\S*[\p{L}\p{N}_]"
RAW_URL = r"(https?|ftp)://\S+"

# A token has a letter; digits, # and _ may be anywhere in it and apostrophes inside it.
# Numbers, punctuation and symbols on their own are therefore no tokens.
TOKEN = r"[\p{N}#_]*\p{L}[\p{L}\p{N}#_]*(?:'[\p{L}\p{N}#_]+)*"

# Features dropped by name.
DROPPED_FEATURES = ("", "amp")

# The English stop words of Spark's own StopWordsRemover, in its order.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until while of at by for with
    about against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd
    she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't
    haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could
    here's how's let's ought that's there's what's when's where's who's why's would
    """.split()
)


def _where_present(text: Column, mark: str, replaced: Column) -> Column:
    """Run a regular expression only on texts that hold a literal every match must contain."""
    return F.when(F.instr(text, mark) > 0, replaced).otherwise(text)


def remove_mentions(text: Column) -> Column:
    """Delete @names, accented letters included."""
    return _where_present(text, "@", F.regexp_replace(text, MENTION, ""))


def remove_tags(text: Column) -> Column:
    """Replace <...> without inner spaces by a space."""
    return _where_present(text, "<", F.regexp_replace(text, TAG, " "))


def repair_encoding(text: Column) -> Column:
    """Restore the broken apostrophe, then delete what is left of wrongly decoded characters.

    All of them take more than one byte, so a text with as many bytes as characters is left alone.
    """
    repaired = F.translate(F.replace(text, F.lit(BROKEN_APOSTROPHE), F.lit("'")), STRAY_CHARACTERS, "")
    return F.when(F.octet_length(text) > F.length(text), repaired).otherwise(text)


def remove_urls(text: Column) -> Column:
    """Replace web, ftp and picture links by a space."""
    links = F.regexp_replace(F.regexp_replace(text, URL, " "), PICTURE_LINK, " ")
    return F.when((F.instr(text, "://") > 0) | (F.instr(text, "twitter") > 0), links).otherwise(text)


def split_stops(text: Column) -> Column:
    """Full stops and commas become spaces."""
    return F.replace(F.replace(text, F.lit("."), F.lit(" ")), F.lit(","), F.lit(" "))


def token_array(text: Column) -> Column:
    """Lower-case tokens of a text."""
    plain = _where_present(text, "://", F.regexp_replace(text, RAW_URL, " "))
    return F.regexp_extract_all(F.lower(plain), F.lit(f"({TOKEN})"), 1)
