"""String and code functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BATCH_ID_SEPARATOR, LAST_STAGE, QUERY_TYPE_NAMES, STAGE_NAMES, STORE_NAMES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stage_name(stage_progress: Column | str) -> Column:
    """Stage number -> display name (NULL outside 0..6)."""
    n = _col(stage_progress).cast("int")
    return F.when(n.between(0, LAST_STAGE), F.get(F.array(*[F.lit(s) for s in STAGE_NAMES]), n))


def stage_number(stage: Column | str) -> Column:
    """Display name -> stage number (NULL for unknown names)."""
    names = F.create_map(*[x for i, s in enumerate(STAGE_NAMES) for x in (F.lit(s), F.lit(i))])
    return F.element_at(names, _col(stage))


def next_stage(stage_progress: Column | str) -> Column:
    """The next stage, absorbing at the last one."""
    return F.least(_col(stage_progress) + 1, F.lit(LAST_STAGE))


def batch_id(repo_id: Column | str, repo_version: Column | str, user_id: Column | str) -> Column:
    return F.concat_ws(BATCH_ID_SEPARATOR, _col(repo_id), _col(repo_version), _col(user_id))


def batch_id_part(batch: Column | str, n: int) -> Column:
    """1-based part of a batch id: 1 repo, 2 version, 3 user."""
    return F.split_part(_col(batch), F.lit(BATCH_ID_SEPARATOR), F.lit(n))


def dataset_code(left: Column | str, right: Column | str) -> Column:
    """``LEFT_RIGHT`` in upper case."""
    return F.upper(F.concat(_col(left), F.lit("_"), _col(right)))


def log_stream_name(ts: Column | str) -> Column:
    """Minute stream name y/m/d/h/min without zero padding."""
    return F.date_format(_col(ts), "yyyy/M/d/H/m")


def store_display_name(store: Column | str) -> Column:
    """Store code -> friendly name; unknown codes pass through unchanged."""
    m = F.create_map(*[x for k, v in STORE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _col(store)), _col(store))


def query_type_name(query_type: Column | str) -> Column:
    m = F.create_map(*[x for k, v in QUERY_TYPE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, _col(query_type))


def fraction_count(n: Column | str, pct: Column | str) -> Column:
    """``int(n * f)`` with f given in whole percent, exact in integers."""
    return F.floor(_col(n) * _col(pct) / 100).cast("long")
