"""Headers of an export to canonical columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header spellings of the exports, by canonical column; columns and spellings stand in order of preference.
ALIASES: dict[str, dict[str, list[str]]] = {
    "comprehensive": {
        "report_name": ["custom report", "custom report report name", "report name", "name", "report title", "report"],
        "report_tag": ["report tag", "tag", "tags"],
        "category": ["category"],
        "landing_page": ["worklet landing pages", "worklet landing page"],
        "report_landing_page": ["landing page", "landing pages"],
        "owner": ["owner"],
        "created_by": ["created by", "author"],
        "description": ["description", "desc", "notes"],
        "created_date": ["created date", "created", "date created"],
        "available_usage": ["available usage"],
        "times_run": ["number of times executed", "number of times", "number of times run", "times run", "run count", "executions", "number of runs"],
        "last_updated": ["last updated date", "last updated", "modified", "last modified"],
        "last_run_date": ["last run date", "last run", "last executed"],
        "last_run_by": ["last run by", "run by"],
        "data_source": ["data source", "datasource", "source", "dataset"],
        "report_type": ["report type", "type"],
        "worklet": ["worklet", "is worklet"],
        "chart_type": ["chart type", "chart"],
        "shared": ["shared", "is shared", "shared status"],
        "report_prompts": ["report prompts", "prompts", "report prompt"],
        "areas_used": ["areas where used", "areas used", "used in", "area where used"],
        "owner_active": ["owner active", "owner status", "active", "is active", "owner state"],
    },
    "runs": {
        "t2_report_name": ["report name", "custom report", "name"],
        "t2_report_type": ["report type", "type"],
        "t2_report_owner": ["report owner", "owner"],
        "t2_data_source": ["report data source name", "data source", "datasource", "source"],
        "t2_start_date": ["start date and time", "start date", "execution date", "run date"],
        "t2_last_run_date": ["last run date", "last run", "last executed"],
        "t2_requested_by": ["requested by name", "requested by", "requester"],
        "t2_requested_id": ["requested by employee id", "employee id", "requester id", "requested by id"],
        "t2_exec_mode": ["execution mode", "mode"],
        "t2_exec_type": ["execution type", "exec type"],
        "t2_areas_used": ["area where used", "areas where used", "areas used", "used in"],
    },
    "fields": {
        "t3_report_name": ["report name", "custom report", "custom report name", "where used report", "report"],
        "t3_report_id": ["report id", "custom report id", "report reference id"],
        "t3_where_used": ["where_used", "where used", "used in", "usage"],
        "t3_business_object": ["business object", "bo", "primary business object"],
        "t3_field_name": ["field name", "report field", "field"],
        "t3_description": ["description", "field description"],
        "t3_report_field_type": ["report field type", "field type"],
        "t3_related_business_object": ["related business object name", "related business object", "related bo"],
        "t3_built_in_prompts": ["built-in prompts", "built in prompts", "builtin prompts"],
        "t3_domain": ["domain"],
        "t3_categories": ["categories", "category"],
        "t3_authorized_usage": ["authorized usage", "usage authorization"],
    },
}


def plain(header: str) -> str:
    return re.sub(r"[\s_\-/]+", " ", header).strip().lower()


def match_headers(headers: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """{canonical: header}, each header once: exact spellings for all columns first, then spellings that contain each other.

    Of several headers that fit, the one of the most preferred spelling is taken, then the first.
    """
    known = {h: plain(h) for h in headers if plain(h)}
    tests: list[Callable[[str, str], bool]] = [lambda p, n: p == n, lambda p, n: n in p or p in n]
    out: dict[str, str] = {}
    for fits in tests:
        for key, names in aliases.items():
            free = [h for h in known if h not in out.values()]
            ranked = [(i, k, h) for i, n in enumerate(map(plain, names)) for k, h in enumerate(free) if fits(known[h], n)]
            if key not in out and ranked:
                out[key] = min(ranked)[2]
    return out


def canonical(df: DataFrame, kind: str) -> DataFrame:
    """All canonical columns of a kind, null where the export lacks one, and ``row_id``."""
    found = match_headers([c for c in df.columns if c != "row_id"], ALIASES[kind])
    return df.select("row_id", *[F.col(f"`{found[k]}`").alias(k) if k in found else F.lit(None).cast("string").alias(k) for k in ALIASES[kind]])
