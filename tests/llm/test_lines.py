import random
import re
import time
from collections import Counter

from vecspark.llm import lines


def brute(pages, ratio, least):
    out, held, total = [], Counter(), Counter()
    parsed = []
    for i, url, html in pages:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        host = m[1].lower() if m else ""
        t = re.sub(r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "\n", html or "")
        ls = [x.strip(" \t\x0b\x0c") for x in re.split(r"[\n\r]", re.sub(r"<[^>]*>", "\n", t))]
        ls = [x for x in ls if x]
        parsed.append((i, host, ls))
        total[host] += 1
        held.update((host, x) for x in set(ls))
    for i, host, ls in parsed:
        keep = [x for x in ls if not (held[host, x] >= least and held[host, x] > ratio * total[host])]
        out.append((i, host, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_equals_brute_force_on_hard_pages(spark):
    pages = [(i, f"https://user@Hot.example.org:80/p{i}", f"<p>menu</p>line {i % 7}<br>menu\n<script>menu</script><!-- x --> own {i}") for i in range(60)]
    pages += [(60, None, "<p>menu"), (61, "no url", None), (62, "http://a.b/", ""), (None, "http://a.b", "one\r\ntwo\tthree "),
              (1, "http://hot.example.org", "menu"), (1, "http://hot.example.org", "menu"), (63, "http://c.d?x", "only page's line")]
    d = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in pages], "page_id long, url string, html string, host string, lines int")
    got = [tuple(r) for r in lines.drop_boilerplate(d, 0.3, 3).select("page_id", "host", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=repr) == brute(pages, 0.3, 3)


def test_equals_brute_force_on_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = [(r.page_id, r.url, r.html) for r in d.collect()]
    got = [tuple(r) for r in lines.drop_boilerplate(d, 0.3, 3).select("page_id", "host", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=repr) == brute(pages, 0.3, 3)


def test_empty_table(spark):
    assert lines.drop_boilerplate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_open_marks_equal_the_plain_patterns(spark):
    marks = ["<script>", "</script>", "<SCRIPT a='x'>", "<script", "<style>", "</STYLE>", "<!--", "-->", "<!-->", "<", ">", "a", "\n", "\ue000", "\ue000\ue002",
             "\ue001", "İ", "<p>", "</script", "--", " "]
    rng = random.Random(5)
    pages = [(i, "http://a.b/", "".join(rng.choice(marks) for _ in range(rng.randint(1, 14)))) for i in range(4000)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [tuple(r) for r in lines.drop_boilerplate(d, 2.0, 3).select("page_id", "host", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=repr) == brute(pages, 2.0, 3)


def test_two_megabyte_pages_take_linear_time(spark):
    size = 2 << 20
    kinds = ["<", "<script>", "<script", "<style>", "<!--", "<!-- <script> <style", "<script </script", "plain words and more\n"]
    pages = [(i, f"http://h{i}.org/", k * (size // len(k))) for i, k in enumerate(kinds)]
    pages += [(20, "http://x.org/", "<script>" * (size // 8) + "</script>tail"), (21, "http://y.org/", "<p>" * (size // 3))]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    began = time.time()
    got = {r.page_id: r.n_lines for r in lines.drop_boilerplate(d, 0.3, 3).collect()}
    assert time.time() - began < 60 and got[0] == 1 and got[20] == 1 and got[21] == 0
