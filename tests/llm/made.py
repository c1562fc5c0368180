"""Bodies made of lines given by hand."""

import numpy as np
import pyarrow as pa

from cairnlake.llm.bodies import BODY, feature_columns, line_arrays
from cairnlake.llm.features import Lines


def made(spark, mains, sites=("a.example",), kinds=None):
    """One body for each list of ``(tag, text)``; sites take turns."""
    memo = Lines()
    flat = [(i, t, x, (kinds or {}).get((i, k), 0)) for i, m in enumerate(mains) for k, (t, x) in enumerate(m)]
    lines = line_arrays([memo[x] for _, _, x, _ in flat])
    used = lines.pop("words")
    page, kind = (np.array([f[k] for f in flat], np.int64) for k in (0, 3))
    columns = feature_columns(len(mains), page, np.arange(len(flat)), [f[1] for f in flat], kind, lines, used)
    ids = {"content_id": pa.array([f"c{i:03d}" for i in range(len(mains))]), "site": pa.array([sites[i % len(sites)] for i in range(len(mains))]), "page": pa.array(range(len(mains)), pa.int64())}
    return spark.createDataFrame(pa.table(ids | columns), BODY)
