"""Token-id sequences as ARRAY<INT> columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmill.functions.text import words

# Marker ids, the loss mask, and the two length limits of the model input.
BOS, PAD, EOS = 0, 1, 2
MASKED = -100
SOURCE_LIMIT = 512
TARGET_LIMIT = 128
VOCABULARY = 50_000


def hashed_ids(tokens: Column) -> Column:
    """Stand-in vocabulary: each word's id is a hash, offset past the marker ids."""
    def one(word):
        return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % VOCABULARY + 4).cast("int")
    return F.transform(tokens, one)


def encode(text: Column, limit: int, to_ids=hashed_ids) -> Column:
    """Ids of the first words that fit into ``limit``, with start and end markers.

    Words past the limit are not split off: the last two pieces leave room for an empty one
    before the first word and for the rest of the text.
    """
    body = to_ids(F.slice(words(text, limit), 1, limit - 2))
    return F.concat(F.array(F.lit(BOS)), body, F.array(F.lit(EOS)))


def truncate_ids(ids: Column, limit: int) -> Column:
    """The same cut for content ids that come from some other tokenizer."""
    return F.concat(F.array(F.lit(BOS)), F.slice(ids, 1, limit - 2), F.array(F.lit(EOS)))


def unmask(labels: Column, pad: int = PAD) -> Column:
    return F.transform(labels, lambda x: F.when(x == MASKED, F.lit(pad)).otherwise(x))


def pad_to(ids: Column, length: Column, filler: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(filler), length - F.size(ids)))
