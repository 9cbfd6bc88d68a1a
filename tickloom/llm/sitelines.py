"""Boilerplate lines by their frequency within a site.

A page's lines are the texts between its block elements. Per host, the pages that contain a line are divided by all
pages of the host; a line found on more than ``ratio`` of them is boilerplate of that host and dropped from all its
pages. A line must repeat to be boilerplate: it is on two pages of the host at least, whatever the size of the host. So a
lone page loses nothing, and ``host_pages`` says on how many pages the decision rests.

Lines are counted by a 128-bit digest, each once per page, added up on the map side before they move. The digests above
the ratio fit one short list per host: if pages have ``k`` lines on average, at most ``k / ratio`` lines can exceed it.
The pages never move by host to be counted; they meet the lists of their hosts in a join that adaptive execution splits
when a host holds much of the table.

Everything is DataFrame expressions. Rows: a null url (or one without a host) belongs to the host ``""``; a null page
has no lines and an empty text; pages that repeat are pages of their own; lines are compared after references are left
undecoded, runs of white space become one space and ends are cut; empty lines vanish. Empty tables give an empty
result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.3

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: An element that is not closed hides the rest of the page; a tag ends before the next one begins.
HIDDEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<head\b.*?(?:</head\s*>|\z)|<!--.*?(?:-->|\z)"
BLOCK = (r"(?i)</?(?:address|article|aside|blockquote|body|br|button|caption|dd|details|div|dl|dt|fieldset|figcaption|"
         r"figure|footer|form|h[1-6]|header|hr|html|legend|li|main|nav|ol|option|p|pre|section|select|summary|table|"
         r"tbody|td|tfoot|th|thead|tr|ul)\b[^<>]*>")
TAG = r"<[^<>]*>"
#: The same matches for less work: one sign tells where an element may begin, and a single space is left as it is.
HIDDEN_FAST = (r"(?is)<(?:script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|head\b.*?(?:</head\s*>|\z)|!--.*?(?:-->|\z))")
SPACES_FAST = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
BLOCK_FAST = (r"(?i)</?(?:a(?:ddress|rticle|side)|b(?:lockquote|ody|r|utton)|caption|d(?:d|etails|iv|l|t)|f(?:ieldset|igcaption|igure|ooter|orm)|"
              r"h(?:[1-6]|eader|r|tml)|l(?:egend|i)|main|nav|o(?:l|ption)|p(?:re)?|s(?:ection|elect|ummary)|t(?:able|body|d|foot|h|head|r)|ul)\b[^<>]*>")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def page_lines(html: Column) -> Column:
    """The texts between block elements, in order."""
    shown = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN_FAST, " "), SPACES_FAST, " ")
    lines = F.split(F.regexp_replace(F.regexp_replace(shown, BLOCK_FAST, "\n"), TAG, ""), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def without_boilerplate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                        ratio: float = RATIO) -> DataFrame:
    """One row per page: identifier, ``host``, ``host_pages``, the kept lines as ``text``, ``n_lines`` and ``n_dropped``."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        page_lines(F.col(html_col)).alias("lines"))
    on_page = rows.select("host", F.explode(F.array_distinct("lines")).alias("line")).select(
        "host", F.md5("line").alias("line"))
    per_line = on_page.groupBy("host", "line").agg(F.count("*").alias("n"))
    per_host = pages.select(host_of(F.col(url_col)).alias("host")).groupBy("host").agg(F.count("*").alias("pages"))
    share = round(ratio * 1000)
    lists = (per_line.where("n > 1").join(per_host, "host").where(F.col("n") * 1000 > F.col("pages") * share)
             .groupBy("host").agg(F.collect_list("line").alias("boilerplate")))
    lists = per_host.join(lists, "host", "left")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("boilerplate", F.md5(x))))
    return rows.join(lists, "host").select(
        "page_id", "host", "pages", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines")).select(
        "page_id", "host", F.col("pages").alias("host_pages"), F.array_join("kept", "\n").alias("text"), "n_lines",
        (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"))


SQL = rf"""WITH shown AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
  regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM pages),
rows_ AS (SELECT row_number() OVER () AS row_id, page_id, host, list_filter(list_transform(string_split(regexp_replace(
  regexp_replace(t, '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM shown),
pos AS (SELECT row_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM rows_),
per_line AS (SELECT host, line, count(DISTINCT row_id) AS n FROM pos GROUP BY ALL),
per_host AS (SELECT host, count(*) AS pages FROM rows_ GROUP BY host),
bad AS (SELECT host, line FROM per_line JOIN per_host USING (host) WHERE n > 1 AND n * 1000 > pages * {round(RATIO * 1000)}),
kept AS (SELECT row_id, string_agg(line, chr(10) ORDER BY place) AS text, count(*) AS n FROM pos ANTI JOIN bad USING (host, line)
  GROUP BY row_id)
SELECT page_id, rows_.host, pages AS host_pages, coalesce(text, '') AS text, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped FROM rows_ JOIN per_host USING (host) LEFT JOIN kept USING (row_id)"""
