"""Language labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-letter code, three-letter code and English name of each language.
LANGUAGES = [
    ("en", "eng", "english"), ("es", "spa", "spanish"), ("fr", "fra", "french"), ("de", "deu", "german"), ("ru", "rus", "russian"),
    ("ar", "ara", "arabic"), ("hi", "hin", "hindi"), ("ko", "kor", "korean"), ("zh", "zho", "chinese"), ("ja", "jpn", "japanese"),
]
CODES = [x[0] for x in LANGUAGES]


def language_code(label: Column) -> Column:
    """Two-letter code of a label in any spelling; null for a missing, unknown or foreign one."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_].*)?$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for code, *names in LANGUAGES for name in (code, *names) for x in (name, code)]), F.when(base != "", base))
