"""DuckDB twins of ``vecspark.sources.fixtures`` for the correctness oracle.

``cte("base", "tags")`` returns a ``WITH`` clause defining the named tables and
everything they depend on, in dependency order.  Distances are written as
ordered list sums over DOUBLE elements so they equal the Spark side bit for bit.
"""

from __future__ import annotations

# name -> (dependencies, body)
_DEFS: dict[str, tuple[tuple[str, ...], str]] = {
    "vectors": ((), "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label, "
                    "vec_id % 50 AS doc_id FROM embeddings"),
    "vectors_scaled": (("vectors",), "SELECT id, list_transform(v, lambda x: x * (1 + id % 5)) AS v, "
                                     "label, doc_id FROM vectors"),
    "queries": (("vectors",), "SELECT id AS qid, v AS qv, label FROM vectors WHERE id % 25 = 0"),
    "base": (("vectors",), "SELECT * FROM vectors WHERE id % 25 <> 0"),
    "squeries": (("vectors_scaled",), "SELECT id AS qid, v AS qv, label FROM vectors_scaled WHERE id % 25 = 0"),
    "sbase": (("vectors_scaled",), "SELECT * FROM vectors_scaled WHERE id % 25 <> 0"),
    "cents": (("vectors",), "SELECT id AS cid, v AS c FROM vectors WHERE id % (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) FROM vectors) = 0"),
    "tags": (("vectors",), "SELECT id, CAST(j AS INTEGER) AS tag FROM vectors, range(20) r(j) "
                           "WHERE (id * (2 * j + 5) + 7 * j) % (j + 3) = 0 "
                           "UNION ALL SELECT id, CAST(100 + label AS INTEGER) AS tag FROM vectors"),
    "tag_arr": (("tags",), "SELECT id, list_sort(list(tag)) AS tags FROM tags GROUP BY id"),
    "attrs": (("vectors",), "SELECT id, CAST((id * 7919) % 1000 AS DOUBLE) / 1000.0 AS a0, "
                            "CAST((id * 104729) % 1000 AS DOUBLE) / 1000.0 AS a1 FROM vectors"),
    "filters_tag": (("queries",),
                    "SELECT qid, CASE WHEN (qid // 25) % 10 = 9 THEN CAST([] AS INTEGER[]) "
                    "WHEN (qid // 25) % 3 = 0 THEN [CAST((qid // 25) % 5 AS INTEGER)] "
                    "ELSE [CAST((qid // 25) % 5 AS INTEGER), CAST(5 + (qid // 25) % 4 AS INTEGER)] END AS ftags "
                    "FROM queries"),
    "filters_range": (("queries",),
                      "SELECT qid, CAST((qid // 25) % 7 AS DOUBLE) / 10.0 AS lo0, CAST((qid // 25) % 7 AS DOUBLE) / 10.0 + 0.4 AS hi0, "
                      "CAST((qid // 25) % 5 AS DOUBLE) / 10.0 AS lo1, CAST((qid // 25) % 5 AS DOUBLE) / 10.0 + 0.5 AS hi1 FROM queries"),
    "workload": ((), "SELECT seq, CASE WHEN t % 3 = 0 THEN [CAST(t % 11 AS INTEGER)] "
                     "ELSE [CAST(t % 11 AS INTEGER), CAST(11 + t % 9 AS INTEGER)] END AS ftags "
                     "FROM (SELECT event_id AS seq, (1000 // (event_id % 1000 + 1) + 7 * (event_id // 5000)) % 61 AS t FROM events)"),
    "sparse_docs": ((), "SELECT doc_id AS id, dim, CAST(count(*) AS DOUBLE) AS w "
                        "FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS dim FROM documents) "
                        "GROUP BY doc_id, dim"),
    "sparse_queries": ((), "SELECT item_id AS qid, dim, CAST(count(*) AS DOUBLE) AS w "
                           "FROM (SELECT item_id, unnest(string_split(text, ' ')) AS dim FROM benchmark) "
                           "GROUP BY item_id, dim"),
    "runbook": ((), "SELECT step, op, CAST(s10 * n / 10 AS BIGINT) AS \"start\", CAST(e10 * n / 10 AS BIGINT) AS \"end\" "
                    "FROM (VALUES (1, 'insert', 0, 6), (2, 'search', NULL, NULL), (3, 'insert', 6, 10), "
                    "(4, 'delete', 2, 5), (5, 'search', NULL, NULL), (6, 'insert', 2, 3), "
                    "(7, 'search', NULL, NULL)) rb(step, op, s10, e10), (SELECT count(*) AS n FROM embeddings)"),
    "op_log": ((), "SELECT event_id AS seq, user_id AS id, CASE WHEN event_type IN ('signup', 'purchase') "
                   "THEN 'insert' WHEN event_type = 'error' THEN 'delete' ELSE 'search' END AS op FROM events"),
    "runs": ((), "SELECT event_id AS run_id, event_type AS algorithm, 'p' || CAST(event_id % 7 AS VARCHAR) AS parameters, "
                 "'ds' || CAST(user_id % 3 AS VARCHAR) AS dataset, "
                 "CASE WHEN user_id % 2 = 0 THEN 'filter' ELSE 'ood' END AS track, 10 AS count, "
                 "value * 100.0 AS qps, CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS recall, "
                 "CAST((event_id * 104729) % 500 AS DOUBLE) / 10.0 AS build, CAST((event_id % 97) * 1024 AS BIGINT) AS indexsize, "
                 "CAST((event_id * 31) % 1000 AS DOUBLE) * 10.0 AS distcomps, CAST((event_id * 17) % 100 AS DOUBLE) / 1000.0 AS mean_latency, "
                 "value * 5.0 AS watt_seconds, CAST((event_id % 4) + 1 AS BIGINT) AS run_count, "
                 "value / 10.0 + CAST(event_id % 5 AS DOUBLE) AS t_first, value / 10.0 + CAST(event_id % 3 AS DOUBLE) AS t_last FROM events"),
}


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def ip(a: str, b: str) -> str:
    return f"(1.0 - {dot(a, b)})"


def cosine(a: str, b: str) -> str:
    return f"(1.0 - {dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)}))"


DIST = {"l2": l2, "ip": ip, "cosine": cosine}


def cte(*names: str, extra: str = "") -> str:
    """``WITH`` clause for the given fixture names (plus dependencies) and optional extra CTE text."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in _DEFS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({_DEFS[n][1]})" for n in order]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
