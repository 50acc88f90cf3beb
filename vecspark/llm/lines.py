"""Line dedup by site-relative frequency (DataFrame functions only).

A page's lines are its visible text pieces: scripts, styles and comments are removed, tags and line breaks separate
lines, and surrounding white space goes.  Per host, the share of pages that hold a line is pages with the line divided
by pages of the host; lines with a share above ``max_ratio`` on at least ``min_pages`` pages are boilerplate and are
dropped from every page of that host.

How it scales: a page's lines are made distinct within its row, so a line is counted once a page; lines are counted by
their 128-bit digest and combined before the shuffle; a host has at most (mean distinct lines of its pages /
max_ratio) boilerplate lines, a bound on the array of digests that is joined back to the pages.  Hosts with more than
1/HOT of all pages (fewer than HOT of them) get theirs by broadcast, so their pages stay where they are; the other
pages meet theirs by host.

Long pages: a pattern that begins at an opening mark without its closing one would search to the end of the page, once for
every such mark.  So on pages that may have such marks those behind the last place that can still close them are found first and
masked, and tags are looked for up to the last ``>`` only: every attempt then succeeds and the work grows with the
length of the page.  The result is that of the plain patterns.

Edge cases: a null url (or one without a host) is the empty host; a null or empty html has no lines and an empty
text; very long pages are read whole; every row is a page, also if rows or page_ids repeat; lines with equal shares are
treated alike, there is nothing to break a tie; an empty table gives an empty result.  Only page_id, url and html are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm import common

HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TAG = r"<[^>]*>"
#: masks of opening marks: two characters of the private use area, of which the first is doubled where a page has it
ESCAPE, PLAIN, MASK = "\ue000", "\ue001", "\ue002"
MASKED = "<" + ESCAPE + MASK
HOT = 64
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _after(text: Column, mark: str) -> Column:
    """What follows the last ``mark`` of ``text``; all of it where there is none."""
    return F.substring_index(text, mark, -1)


def _last(text: Column, mark: str) -> Column:
    """Place (from 1) of the last ``mark`` in ``text``, 0 if there is none."""
    return F.when(F.contains(text, F.lit(mark)), F.length(text) - F.length(_after(text, mark)) - len(mark) + 1).otherwise(F.lit(0))


def _mask(text: Column, opening: str, search: Column, alive: Column) -> Column:
    """``text`` with every ``opening`` mark behind place ``alive`` masked; ``search`` is ``text`` as the mark is looked for in it."""
    dead = F.regexp_replace(F.substr(text, alive + 1, F.length(text)), f"(?i)<(?={opening[1:]})", MASKED)
    none = F.call_function("locate", F.lit(opening), search, F.greatest(alive, F.lit(1))) == 0
    return F.when(none, text).otherwise(F.concat(F.substr(text, F.lit(1), alive), dead))


def _masked(html: Column) -> Column:
    """``html`` with MASK behind the ``<`` of every opening mark that nothing closes; own ESCAPE characters are doubled."""
    def element(text: Column, name: str) -> Column:
        low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)       # as (?i): A-Z only, lengths stay

        def places(low: Column) -> Column:
            return _let(_last(low, f"</{name}>"), lambda close: _let(       # an opening mark ends before the closing one
                F.when(close == 0, F.lit(0)).otherwise(_last(F.substr(text, F.lit(1), close - 1), ">")), lambda alive: _mask(text, "<" + name, low, alive)))
        return _let(low, places)

    def comments(text: Column) -> Column:
        return _let(F.greatest(_last(text, "-->") - 4, F.lit(0)), lambda alive: _mask(text, "<!--", text, alive))

    text = F.replace(html, F.lit(ESCAPE), F.lit(ESCAPE + PLAIN))
    return _let(_let(_let(text, lambda t: element(t, "script")), lambda t: element(t, "style")), comments)


def _open(html: Column, low: Column) -> Column:
    """Whether an opening mark may be without its closing one (never false where one is); ``low`` is ``html`` in small letters."""
    def element(name: str) -> Column:
        def near(tail: Column) -> Column:      # between the last '>' before the last closing mark and that mark
            before = F.substr(low, F.lit(1), F.length(low) - F.length(tail) - len(name) - 3)
            return F.contains(tail, F.lit("<" + name)) | F.contains(_after(before, ">"), F.lit("<" + name))
        return F.contains(low, F.lit("<" + name)) & _let(_after(low, f"</{name}>"), near)

    marks = [F.contains(html, F.lit(m)) for m in ("<!-->", "<!--->")] + [F.contains(_after(html, "-->"), F.lit("<!--"))]
    return element("script") | element("style") | marks[0] | marks[1] | marks[2]


def visible(html: Column) -> Column:
    """The page without scripts, styles, comments and tags, each of them a line break."""
    def untagged(text: Column) -> Column:
        end = F.length(text) - F.length(_after(text, ">"))
        return F.concat(F.regexp_replace(F.substr(text, F.lit(1), end), TAG, "\n"), _after(text, ">"))

    def masked(text: Column) -> Column:
        shown = _let(F.regexp_replace(_masked(text), HIDDEN, "\n"), untagged)
        return F.replace(F.replace(shown, F.lit(ESCAPE + MASK), F.lit("")), F.lit(ESCAPE + PLAIN), F.lit(ESCAPE))

    def shown(low: Column) -> Column:
        none = ~(F.contains(low, F.lit("<script")) | F.contains(low, F.lit("<style")) | F.contains(html, F.lit("<!--")))
        return (F.when(none, untagged(html)).when(_open(html, low), masked(html))
                .otherwise(_let(F.regexp_replace(html, HIDDEN, "\n"), untagged)))

    return _let(F.lower(html), shown)


def lines_of(html: Column) -> Column:
    text = visible(F.coalesce(html, F.lit("")))
    pieces = F.transform(F.split(text, "[\n\r]"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c")))
    return F.filter(pieces, lambda x: x != "")


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, host, lines) of every page."""
    return pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"),
                        lines_of(F.col("html").cast("string")).alias("lines"))


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(lines: DataFrame, totals: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, drop): digests of the boilerplate lines of each host that has any; ``totals`` is (host, pages)."""
    seen = F.array_distinct(F.transform("lines", digest))
    held = (lines.select("host", F.explode(seen).alias("line"))
            .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages))
    return (held.join(totals, "host").filter(F.col("n") > F.lit(max_ratio) * F.col("pages"))
            .groupBy("host").agg(F.collect_list("line").alias("drop")))


def drop_boilerplate(pages: DataFrame, max_ratio: float = 0.3, min_pages: int = 3) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text): every page without its host's boilerplate lines."""
    lines = common.stored(page_lines(pages), "lines")
    totals = common.stored(lines.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    n = totals.agg(F.sum("pages")).first()[0] or 0
    drop = common.stored(boilerplate(lines, totals, max_ratio, min_pages), "boilerplate")
    hot = F.broadcast(totals.filter(F.col("pages") * HOT > n).select("host"))          # fewer than HOT rows
    large = lines.join(F.broadcast(hot.join(drop, "host", "left")), "host")
    small = lines.join(hot, "host", "left_anti").join(drop, "host", "left")
    both = large.select("page_id", "host", "lines", "drop").unionByName(small.select("page_id", "host", "lines", "drop"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("drop", digest(x))))
    return (both.withColumn("kept", kept)
            .select("page_id", "host", F.size("lines").cast("long").alias("n_lines"),
                    (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
                    F.array_join("kept", "\n").alias("text")))
