"""DuckDB SQL for the centroid clustering: its rounds, written out."""

from __future__ import annotations


def cluster_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:") -> str:
    """Rows as ``centroids.cluster`` gives them for ``embeddings``; every round is a table of centroids made of the one before."""
    distance = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"

    def assign(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT vec_id, v, cluster, distance FROM (
          SELECT v.vec_id, v.v, c.cluster, {distance} AS distance FROM v CROSS JOIN c{r} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""

    def move(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
          SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {dims + 1})) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY 1) m USING (cluster))"""

    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS cluster, v FROM v ORDER BY 1 LIMIT {k})",
    ]
    for r in range(rounds):
        steps += [assign(r), move(r)]
    steps.append(assign(rounds))
    return f"""WITH {', '.join(steps)}
      SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia,
        sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""
