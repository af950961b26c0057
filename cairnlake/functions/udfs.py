"""The few functions that need Python: Unicode normalisation, YAML headers, review diffs. All are vectorised."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

#: Texts whose words are Python objects at once.
SLICE = 128


def literal_unicode_tokens(text: str | None) -> list[str]:
    return sorted(set(re.findall(r"\w+", unicodedata.normalize("NFKC", text or "").lower())))


@F.arrow_udf(ArrayType(StringType()))
def unicode_tokens(texts: pa.Array) -> pa.Array:
    """Distinct NFKC lower-case words, sorted."""
    kind = pa.list_(pa.string())
    parts = [pa.array([literal_unicode_tokens(t) for t in texts.slice(i, SLICE).to_pylist()], kind) for i in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.pandas_udf(MapType(StringType(), StringType()))
def yaml_fields(headers: pd.Series) -> pd.Series:
    """Top-level fields of a YAML header as strings; an invalid header has none."""
    import yaml

    def read(text: str) -> dict:
        try:
            data = yaml.safe_load(text) if text else {}
        except yaml.YAMLError:
            return {}
        return {str(k): None if v is None else str(v) for k, v in data.items()} if isinstance(data, dict) else {}

    return headers.map(read)


@F.pandas_udf(StringType())
def review_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Line differences of a text before and after redaction."""
    diff = lambda a, b: "\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm=""))
    return pd.Series([diff(a, b) for a, b in zip(before, after)])
