"""Language identification by compression.

A language's model is a raw-content zstandard dictionary: sampled text of that language, put end to end, but
for lines that the samples of two languages share. Texts count in lower case, with all but letters as spaces.
A text is cut into blocks, every block is compressed with every dictionary, and the dictionary with the
smallest total names the language. A narrow margin between the two smallest totals is a rejection.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import id_crc, row_tag, small_batches

UNKNOWN = "und"
#: Bounds of the fitted sample: languages, texts of each, characters of each text, bytes of a dictionary.
MAX_LANGS, TEXTS, CHARS, DICT_BYTES = 128, 256, 4096, 256 << 10
BLOCK, LEVEL = 4096, 3
#: Below this share of the second smallest total the margin is too narrow to decide.
MIN_MARGIN = 0.002
_OTHER = re.compile(r"[\W\d_]+")
SCHEMA = "doc_id bigint, tag bigint, lang_pred string, score double, margin double, rejected boolean"


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries from a bounded sample: of each language the TEXTS rows with the smallest tag (a hash of id and text).

    Few more than these are ranked at all: of a frequent language only the rows under a tag that four times as many are
    expected under. Texts travel for the chosen rows only. Rows without text or language, and languages beyond
    the MAX_LANGS most frequent, teach nothing; of rows that repeat whole one teaches.
    """
    named = docs.filter(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), row_tag(id_col, text_col).alias("tag")
    )
    langs = {r["lang"]: r["count"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    if not langs:
        return {}
    low = F.create_map(*[x for k, n in langs.items() for x in (F.lit(k), F.lit(min(1.0, 4 * TEXTS / n)))])
    place = (F.col("tag").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)  # of the tag among all numbers, 0 to 1
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("tag"))
    ids = named.select("lang", "tag").filter(place <= F.try_element_at(low, F.col("lang"))).distinct().withColumn("rank", rank).filter(F.col("rank") <= TEXTS)
    rows = named.join(F.broadcast(ids.select("lang", "tag")), ["lang", "tag"], "left_semi").dropDuplicates(["lang", "tag"])
    sample = rows.select("lang", F.substring("text", 1, CHARS).alias("text"), F.col("tag").alias("h"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in sample.toLocalIterator():
        texts.setdefault(r["lang"], []).append((r["h"], r["text"]))
    lines = Counter(line for v in texts.values() for line in {line for _, t in v for line in t.split("\n")})
    own = {k: [[line for line in t.split("\n") if lines[line] == 1] for _, t in sorted(v)[:TEXTS]] for k, v in texts.items()}
    return {k: " ".join(plain(" ".join(t)) for t in v).encode()[-DICT_BYTES:] for k, v in sorted(own.items())}


def plain(text: str) -> str:
    """Lower case, with runs of anything but letters as one space."""
    return _OTHER.sub(" ", text.lower())


class Compressors:
    """One compressor for each language, made once in a worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.langs = sorted(k for k, v in dictionaries.items() if len(v) >= 8)
        self.by = []
        for k in self.langs:
            d = z.ZstdCompressionDict(dictionaries[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score from 0 to 1, margin, rejected). Ties go to the first name in code-point order."""
        if not text or not self.langs or not (text.isalpha() or any(map(str.isalpha, text))):
            return UNKNOWN, 0.0, 0.0, True
        data = plain(text).encode()
        blocks = [data] if len(data) <= BLOCK else [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(f(b)) for b in blocks) for f in self.by]
        best = min(sizes)
        i = sizes.index(best)
        second = min(sizes[:i] + sizes[i + 1 :], default=2 * best)
        margin = (second - best) / max(second, 1)
        unit = 1 + 0.01 * best
        score = 1 / sum(math.exp((best - s) / unit) for s in sizes)
        return self.langs[i], score, margin, margin < MIN_MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (see ``row_tag``), lang_pred, score, margin, rejected for every row.

    A null or empty text, or one without any letter, is ``und`` with score 0 and rejected. With one learned
    language the margin is against twice its size. Repeated rows are answered one by one.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(shipped.value)
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            cols = list(zip(*found)) or [[]] * 4
            yield pa.record_batch(
                [b.column(0), b.column(2), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())],
                names=["doc_id", "tag", "lang_pred", "score", "margin", "rejected"],
            )

    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), row_tag(id_col, text_col).alias("tag"))
    return narrow.mapInArrow(run, SCHEMA)


def train_fold(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows a model may learn from: crc32 of the id, modulo 4, is not 2."""
    return docs.filter(id_crc(id_col) % 4 != 2)
