"""Column-level functions (all JVM-side Spark expressions, no Python UDFs)."""

from graphsift.functions.typing import (  # noqa: F401
    is_boolean, is_date, is_double, is_integer, is_ip, pg_type, xsd_type,
)
from graphsift.functions.sets import euclidean, is_abstract, jaccard  # noqa: F401
from graphsift.functions.text import (  # noqa: F401
    label_key, nquad_literal, safe_name,
)
