"""Main text of web pages by a recurrent labeller of leaf blocks.

The labeller (block_labeller) is trained on pages that made_pages() writes: layouts with
menus, headers, footers, sidebars, notices, adverts, forms and reader comments
around an article, whose true labels are known as they are written; and on TRAIN_PAGES real
pages at most (smallest hashes of their ids, each id once), labelled by the names of their elements. It then decides on every block of every whole page; a page's text is its kept
blocks joined by a space.

Edge cases: a null or empty page, or one without kept blocks, gives an empty text. Broken or
cut markup is read as far as it goes; an element of script, style, form or drawing that never ends reaches to the next block.
Repeated rows and null ids give results of their own, other
columns, whatever their names, are left out, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .block_labeller import Featurizer, Labeller
from .html_blocks import Block, blocks
from .tables import small_batches, table

#: Bounds of the sample of real pages: how many, and the characters and blocks of one that is taken whole.
TRAIN_PAGES, TRAIN_CHARS, TRAIN_BLOCKS = 200, 200_000, 1000
MADE_PAGES = 500
#: Blocks that a worker labels at once, about: bounds the padded batch.
BATCH_BLOCKS = 4096
#: Words of a made page are of these syllables, the same in all its parts: what tells the parts apart are tags, names, places and measures of text.
SYLLABLES = "an be con de el er es ga ing la le men no on or per qua re sta ten ti un ver".split()


#: Words in an element's tag, class, id or role that name what isn't main text.
AROUND = frozenset(
    "nav header footer aside menu sidebar ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert form login signup newsletter subscribe share social related recommended breadcrumb breadcrumbs pagination comment comments reply replies disqus widget toolbar copyright legal popup modal overlay hidden title head button label legend navigation contentinfo complementary search".split()
)
MAIN = frozenset("article main".split())
SPLIT = re.compile(r"[a-z]+")


def by_elements(page: list[Block]) -> np.ndarray:
    """Labels of a real page: inside an article or main element, and in nothing around it."""

    def words(name: str) -> set[str]:
        return set(SPLIT.findall(name))

    inside = [any(w & MAIN or w & {"content", "post", "entry", "story"} for w in map(words, b.path)) for b in page]
    holds = any(inside)
    return np.array([(i or not holds) and not any((words(e) & AROUND) and not (e.split(" ")[0] == "header" and k and "article" in b.path[k - 1].split(" ")[0]) for k, e in enumerate(b.path)) for i, b in zip(inside, page, strict=True)], dtype=np.float32)


def made_words(n: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(SYLLABLES, size=int(rng.integers(1, 5)))) for _ in range(n)]


def made_pages(n: int, seed: int = 11, words: list[str] | None = None) -> list[tuple[list[Block], np.ndarray]]:
    """Pages of many layouts, with the true label of each block."""
    rng = np.random.default_rng(seed)
    words = words or made_words(3000, seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]

    def prose(low: int, high: int) -> str:
        ws = [words[k] for k in rng.integers(len(words), size=int(rng.integers(low, high + 1)))]
        return (" ".join(ws)).capitalize() + pick(".", ".", ".", "", "!", "?")

    around = {
        "menu": lambda: [((pick("nav", "div menu", "div navbar", "ul nav", "div main-menu", "nav navigation", "div topnav"), "ul", "li"), prose(1, 3), 1.0) for _ in range(rng.integers(2, 9))],
        "header": lambda: [((pick("header", "div header", "div site-header", "div masthead", "header banner"), pick("div", "p", "h1", "h2", "div logo")), prose(1, 8), pick(0.0, 1.0)) for _ in range(rng.integers(1, 3))],
        "footer": lambda: [((pick("footer", "div footer", "div site-footer", "footer contentinfo", "div copyright"), *pick((), ("p",), ("div",))), pick("© ", "", "Copyright ") + prose(2, 25), pick(0.0, 0.3)) for _ in range(rng.integers(1, 4))],
        "sidebar": lambda: [((pick("aside", "div sidebar", "aside sidebar", "div widget", "div related", "section related-posts", "div side", "div rail"), pick("p", "div", "h3", "li", "ul")), prose(1, 40), pick(0.0, 1.0)) for _ in range(rng.integers(1, 6))],
        "notice": lambda: [((pick("div notice", "div cookie", "div cookie-banner", "div alert", "div consent", "section notice", "p notice", "div gdpr", "div popup", "div modal", "div message"), *pick((), ("p",), ("div",))), prose(2, 30), 0.0)],
        "advert": lambda: [((pick("div ad", "div ads", "div advert", "div advertisement", "aside ad", "section sponsored", "div promo", "div banner", "div ad-slot", "p ad", "ins ads", "figure ad"), *pick((), ("p",), ("div",))), prose(2, 40), pick(0.0, 1.0))],
        "form": lambda: [((pick("form", "form login", "form search", "form newsletter", "div subscribe", "div signup", "form comment-form"), pick("label", "button", "p", "div", "legend")), prose(1, 10), 0.0) for _ in range(rng.integers(1, 5))],
        "comments": lambda: [((pick("div comments", "section comments", "div comment-list", "ol comments", "div discussion", "section responses", "div replies", "div comment", "ul comments"), *pick((), ("div comment",), ("li",), ("article comment",)), pick("p", "div", "p")), prose(2, 60), 0.0) for _ in range(rng.integers(1, 9))],
        "share": lambda: [((pick("div share", "div social", "ul social-links", "div tags", "div author-box", "div breadcrumb", "nav breadcrumbs", "div pagination", "div toolbar"), pick("a", "li", "span", "div")), prose(1, 4), 1.0) for _ in range(rng.integers(1, 5))],
    }
    out = []
    for _ in range(n):
        whole = pick((), ("div page",), ("div wrapper",), ("div container",), ("div",))
        holder = (*pick(("article",), ("main",), ("main", "article"), ("article post",), ("div content",), ("div article",), ("div post",), ("section main-content",), ("div main", "div entry-content"), ("article", "div article-body"), ("div story-body",), ("section",), ("div", "div"), ("td",)),)
        before = [x for x in ("menu", "header", "notice", "advert", "share", "form", "sidebar") if rng.random() < 0.4]
        rng.shuffle(before)
        after = [x for x in ("comments", "sidebar", "share", "advert", "form", "notice", "menu") if rng.random() < 0.4]
        rng.shuffle(after)
        page: list[tuple[tuple[str, ...], str, float, float]] = []
        base = ("html", "body", *whole)
        if rng.random() < 0.9:
            page.append((("html", "head", "title"), prose(2, 12), 0.0, 0.0))
        for part in before:
            page += [((*base, *p), t, link, 0.0) for p, t, link in around[part]()]
        main = [((*base, *holder, pick("h1", "h1", "h2", "header", "p")), prose(2, 14), 0.0, 1.0)] * int(rng.random() < 0.8)
        for _ in range(int(rng.integers(1, 14))):
            tail = pick(("p",), ("p",), ("p",), ("p",), ("h2",), ("h3",), ("blockquote", "p"), ("ul", "li"), ("ol", "li"), ("pre",), ("table", "tbody", "tr", "td"), ("figure", "figcaption"), ("div",), ("section", "p"), ())
            heading = tail and tail[0] in ("h2", "h3")
            main.append(((*base, *holder, *tail), prose(1, 8) if heading else prose(*pick((1, 6), (8, 60), (20, 120), (20, 120))), pick(0.0, 0.0, 0.1), 1.0))
            if rng.random() < 0.08:
                main += [((*base, *holder, *p), t, link, 0.0) for p, t, link in around[pick("advert", "share", "notice", "sidebar", "form")]()]
        page += main
        if rng.random() < 0.25:
            page += [((*base, *holder, *p), t, link, 0.0) for p, t, link in around["comments"]()]
        for part in after:
            page += [((*base, *p), t, link, 0.0) for p, t, link in around[part]()]
        if rng.random() < 0.8:
            page += [((*base, *p), t, link, 0.0) for p, t, link in around["footer"]()]
        out.append(([Block(p, t, int(link * len(t))) for p, t, link, _ in page], np.array([y for *_, y in page], dtype=np.float32)))
    return out


def train(pages: DataFrame | None = None, train_pages: int = TRAIN_PAGES, made: int = MADE_PAGES) -> Labeller:
    """The labeller of made pages and of pages (page_id, html): at most train_pages of them are read to the driver, whole, of TRAIN_CHARS characters at most each."""
    examples = made_pages(made)
    if pages is not None:
        key = F.coalesce(F.xxhash64("page_id"), F.lit(0))
        fit = pages.where(F.length("html").between(1, TRAIN_CHARS)).select(F.when(F.col("page_id").isNull(), F.xxhash64("html")).otherwise(key).alias("k"), "html")
        ids = fit.select("k").distinct().orderBy("k").limit(train_pages)
        sample = fit.join(F.broadcast(ids), "k", "left_semi").groupBy("k").agg(F.min("html").alias("html")).orderBy("k").collect()  # one of an id's rows
        real = [b for b in (blocks(r.html) for r in sample) if 0 < len(b) <= TRAIN_BLOCKS]
        examples = [(p, by_elements(p)) for p in real] + examples
    look = Featurizer()
    return Labeller.fit([look.page(p) for p, _ in examples], [y for _, y in examples])


def main_text(pages: DataFrame, model: Labeller, html: str = "html", keep: float = 0.5) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, text, n_chars)."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model.weights)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, look = Labeller(shared.value), Featurizer()
        for b in batches:
            texts = [""] * b.num_rows
            parsed = [(k, p) for k, p in enumerate(map(blocks, b.column(2).to_pylist())) if p]
            parsed.sort(key=lambda x: len(x[1]))
            lot: list[tuple[int, list[Block]]] = []

            def label() -> None:
                for (k, page), chance in zip(lot, labeller.probabilities([look.page(p) for _, p in lot]), strict=True):
                    texts[k] = " ".join(x.text for x, c in zip(page, chance, strict=True) if c >= keep)
                lot.clear()

            for k, page in parsed:
                if lot and (len(lot) + 1) * len(page) > BATCH_BLOCKS:
                    label()
                lot.append((k, page))
            label()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html).mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, train(pages))
