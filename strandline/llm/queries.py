"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from strandline.llm import decontam, hilbert, langid, minhash, quality, spotsigs, toxicity, treebpe, urllists, wavelet


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ordinal_quality(spark, folder):
    return quality.ratings(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_wavelet_shards(spark, folder):
    return wavelet.digests(_table(spark, folder, "documents"))


def op3_channel_toxicity(spark, folder):
    return toxicity.scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_spotsigs(spark, folder):
    return spotsigs.digests(_table(spark, folder, "documents"))


def spotsigs_links(spark, folder):
    """The similarity join of op4's signature sets: class and number of links of each document."""
    return spotsigs.links(_table(spark, folder, "documents"))


DAY = 86_400
START = 1_704_067_200  # 2024-01-01 UTC


def url_list_changes() -> list[tuple[str, str, int, bool]]:
    """A dated list: each host is added under three top domains some days apart, removed after 90 days, some added again;
    one busy host and one whole domain are listed for some weeks."""
    changes = []
    for k, name in enumerate(("casino-win", "adult-x", "spam-farm", "cheap-pills", "ads-track", "free-bets")):
        for j, top in enumerate(("com", "net", "org")):
            host, at = f"{name}.example.{top}", START + (40 * k + 11 * j) * DAY
            changes += [("adult" if k == 1 else "abuse", host, at, True), ("adult" if k == 1 else "abuse", host, at + 90 * DAY, False)]
            if k % 2 == 0:
                changes.append(("abuse", host, at + 150 * DAY, True))
    changes += [("abuse", "tionsh.example.net", START + 100 * DAY, True), ("abuse", "tionsh.example.net", START + 130 * DAY, False)]
    changes += [("outage", "example.org", START + 200 * DAY, True), ("outage", "example.org", START + 214 * DAY, False)]
    return changes


def _fetched(page_id: str) -> str:
    """When a page was fetched, in seconds: some minute of 2024, told by its id."""
    return f"{START} + ({page_id} * 7919 * 60) % {366 * DAY}"


def op5_temporal_url_lists(spark, folder):
    pages = _table(spark, folder, "pages").select("page_id", "url").selectExpr("page_id", "url", f"{_fetched('page_id')} AS fetched")
    changes = spark.createDataFrame(url_list_changes(), "list string, host string, at long, added boolean")
    return urllists.verdicts(pages, changes)


def _url_oracle() -> str:
    rows = ", ".join(f"('{a}', '{h}', {t}::BIGINT, {str(x).lower()})" for a, h, t, x in url_list_changes())
    return f"""
WITH changes(list, host, dated, added) AS (VALUES {rows}),
turns AS (SELECT *, lag(added, 1, false) OVER (PARTITION BY list, host ORDER BY dated) AS earlier FROM changes),
spans AS (SELECT list, host, added, dated AS since, lead(dated) OVER (PARTITION BY list, host ORDER BY dated) AS until FROM turns WHERE added <> earlier),
captures AS (SELECT page_id, url, {_fetched('page_id')} AS fetched, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host FROM pages),
met AS (SELECT c.page_id, count(*) AS n, string_agg(DISTINCT s.list, ',' ORDER BY s.list) AS lists FROM captures c JOIN spans s
  ON s.added AND (c.host = s.host OR ends_with(c.host, '.' || s.host)) AND s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until) GROUP BY 1)
SELECT c.page_id, c.url, c.fetched, m.n IS NOT NULL AS listed, coalesce(m.n, 0) AS n_entries, coalesce(m.lists, '') AS lists FROM captures c LEFT JOIN met m USING (page_id)"""


def op6_prefix_decontam(spark, folder):
    return decontam.digests(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_subword_langid(spark, folder):
    return langid.predictions(_table(spark, folder, "documents"))


def op8_tree_bpe(spark, folder):
    return treebpe.digests(_table(spark, folder, "documents"))


def op9_hilbert_shards(spark, folder):
    return hilbert.digests(_table(spark, folder, "documents"))


def op10_minhash(spark, folder):
    return minhash.clusters(_table(spark, folder, "documents"), width=3, percent=85)


QUERIES = {f.__name__: f for f in (op1_ordinal_quality, op2_wavelet_shards, op3_channel_toxicity, op4_spotsigs, op5_temporal_url_lists, op6_prefix_decontam, op7_subword_langid, op8_tree_bpe, op9_hilbert_shards, op10_minhash, spotsigs_links)}
ORACLE_SQL = {"op5_temporal_url_lists": _url_oracle()}
