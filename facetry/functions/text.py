"""Column expressions on texts and token lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The public English stop words that corpora of this kind are cleaned with.
ENGLISH_STOP = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()


def is_int(text: Column) -> Column:
    """Whether a text is an integer, white space around it allowed; false for null."""
    return F.regexp_replace(text, r"^\s+|\s+$", "").try_cast("bigint").isNotNull()


def truncate(text: Column, most: int) -> Column:
    """The first ``most`` words (between single spaces) and `` ...`` where there are more; ``most`` of 0 or less keeps all."""
    if most <= 0:
        return text
    words = F.split(text, " ")
    return F.when(F.size(words) <= most, text).otherwise(F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit(" ...")))


def words_lower(text: Column) -> Column:
    """Lower-cased pieces between single spaces, empty ones included."""
    return F.split(F.lower(text), " ")


def without(words: Column, stop: list[str] = ENGLISH_STOP) -> Column:
    """``words`` without those of the list ``stop`` (case matters), in order and with repetitions; English ones by default."""
    return F.filter(words, lambda w: ~w.isin(stop))


def abstract(text: Column) -> Column:
    """What stands before the first section mark ``= =``, without white space around it."""
    return F.regexp_replace(F.substring_index(text, "= =", 1), r"^\s+|\s+$", "")


def chunks(docs: DataFrame, tokens: str, size: int, overlap: int, keep: list[str]) -> DataFrame:
    """``keep``, chunk_idx, tokens: windows of ``size`` tokens, each begun ``size - overlap`` after the last.

    A step that would not be positive is half the size, 1 at least. Windows end with the first that
    reaches the end; a document without tokens has none.
    """
    step = size - overlap if size > overlap else max(1, size // 2)
    n = F.size(tokens)
    count = F.least(F.greatest(F.lit(1), F.ceil((n - size) / step) + 1), F.ceil(n / step))
    rows = docs.where(n > 0).select(*keep, tokens, F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("chunk_idx"))
    return rows.select(*keep, "chunk_idx", F.slice(tokens, F.col("chunk_idx") * step + 1, size).alias("tokens"))
