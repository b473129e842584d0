"""Language identification and landmarks against plain versions in one process."""

import cmath
import math
import re

import zstandard


from tesserae.llm import langid, media, queries
from tests.llm.test_llm import SF, got, words


def predicted_plainly(text, dictionaries):
    if not text or not any(c.isalpha() for c in text):
        return "und", None
    data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
    sizes = {}
    for lang, d in dictionaries.items():
        one = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[lang] = sum(len(one.compress(data[a : a + 4096])) for a in range(0, len(data), 4096))
    best, second = sorted(sizes.values())[:2]
    return min(k for k, v in sizes.items() if v == best), (second - best) / second


def test_languages_match_compression_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fitted = langid.fit(langid.train_fold(docs))
    out = {r["doc_id"]: r for r in got(langid.identify(docs.repartition(3), fitted))}
    for r in got(docs):
        lang, margin = predicted_plainly(r["text"], fitted)
        told = out[r["doc_id"]]
        assert told["lang_pred"] == lang
        if margin is not None:
            assert abs(told["margin"] - margin) < 1e-9 and told["rejected"] == (margin < langid.MIN_MARGIN)
    query = {r["doc_id"]: r for r in got(queries.queries()["op1_language_id"](spark, SF))}
    assert {i: (r["lang_pred"], r["margin"]) for i, r in query.items()} == {i: (r["lang_pred"], r["margin"]) for i, r in out.items()}


def test_a_language_that_was_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fitted = langid.fit(langid.train_fold(docs).filter("lang <> 'fr'"))
    held = got(langid.identify(docs.filter("lang = 'fr'"), fitted))
    known = got(langid.identify(docs.filter("lang <> 'fr'"), fitted))
    share = lambda rows: sum(r["rejected"] for r in rows) / len(rows)
    margin = lambda rows: sorted(r["margin"] for r in rows)[len(rows) // 2]
    print(f"left-out language: rejected {share(held):.3f} of {len(held)}, median margin {margin(held):.4f}; known: rejected {share(known):.3f}, median margin {margin(known):.4f}")
    assert margin(held) < margin(known) and "fr" not in fitted


def strongest(frame, lo, hi):
    """The strongest bin by the transform's definition, and by how much it leads."""
    n = len(frame)
    power = [abs(sum(x * cmath.exp(-2j * math.pi * k * i / n) for i, x in enumerate(frame))) for k in range(lo, hi)]
    first, second = sorted(power)[-1], sorted(power)[-2]
    return lo + power.index(first), first - second


def test_landmarks_follow_the_definition():
    payload = media.padded(words(77, 400))[: 512 + 2 * 256]
    x = [b - 128 for b in payload]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 511) for i in range(512)]
    told = media.peaks(payload)
    assert len(told) == 3
    for t in range(3):
        frame = [v * w for v, w in zip(x[t * 256 : t * 256 + 512], window)]
        for band, (lo, hi) in enumerate(media.BANDS):
            peak, lead = strongest(frame, lo, hi)
            assert told[t][band] == peak or lead < 1e-2
    want = sorted((t << 24) | (int(told[t][j]) << 13) | (int(told[t + d][1 - j]) << 4) | d for t in range(3) for d in (1, 2) if t + d < 3 for j in (0, 1))
    assert media.landmarks(told).tolist() == want


def test_features_are_the_landmarks_in_hex(spark):
    out = {r["doc_id"]: r["feature"] for r in got(queries.queries()["op8_media"](spark, SF))}
    for r in got(spark.read.parquet(f"{SF}/documents.parquet").limit(20)):
        marks = media.landmarks(media.peaks(media.padded(r["text"])))
        assert out[r["doc_id"]] == ",".join(f"{m:x}" for m in marks.tolist())
