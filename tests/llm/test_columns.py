"""Columns of any name pass through the operators that return a table's rows."""

from pyspark.sql import functions as F

from wavelake.llm.html_text import extract_text
from wavelake.llm.minhash import drop_near_duplicates
from wavelake.llm.repeats import remove_repeats
from wavelake.llm.sharding import assign_shards

NAMES = ["z", "scope", "open", "spans", "in_words", "_t", "_th", "_d", "_full", "_h", "_n", "_each", "_row", "_bare", "a.b", "sid"]


def clashing(df):
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("none"))) for c in NAMES})


def kept(rows, key):
    return all(r[c] == f"{c}:{'none' if r[key] is None else r[key]}" for r in rows for c in NAMES)


def test_columns_of_clashing_names(spark):
    texts = [(1, "one two three four five six"), (2, "one two three four five six"), (3, None), (None, "x" * 900), (5, "y" * 900 + "x" * 900)]
    docs = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    got = drop_near_duplicates(docs).collect()
    assert {r.doc_id for r in got} == {None, 1, 3, 5} and kept(got, "doc_id") and drop_near_duplicates(docs).columns == docs.columns
    got = remove_repeats(docs, 400).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(1, 0), (2, 0), (3, 0), (None, 900), (5, 1800)} and kept(got, "doc_id")
    got = assign_shards(docs, 1000).collect()
    assert len(got) == 5 and kept(got, "doc_id") and all(r.text == dict(texts)[r.doc_id] for r in got)
    page = "<html><body><article><p>Some words of an article.</p></article></body></html>"
    pages = clashing(spark.createDataFrame([(1, "http://a/b", page), (2, "http://a/c", "<p>no article</p>"), (3, None, None)], "page_id long, url string, html string"))
    got = extract_text(pages).collect()
    assert {r.page_id: r.text for r in got} == {1: "Some words of an article.", 2: "no article", 3: ""} and kept(got, "page_id")


def test_a_batch_size_of_the_user_stays(spark):
    from wavelake.llm.common import ship_package

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(64 << 20))
        ship_package(spark)
        assert spark.conf.get(name) == str(64 << 20)
    finally:
        spark.conf.set(name, before)


def test_class_words_do_not_decide_alone_inside_an_article(spark):
    from wavelake.llm.html_text import blocks_of

    text = lambda h: "\n".join(t for k, t in blocks_of(h) if k in ("main", "doubt"))
    inside = lambda h: text(f"<body><nav>Menu</nav><article><p>First.</p>{h}<p>Last.</p></article></body>")
    for part in ("<div class='menu-item'>Soup</div>", "<div class='widget'>Chart text</div>", "<blockquote class='quote related'>A quotation</blockquote>", "<div id='login-history'>Words</div>"):
        assert inside(part).count("\n") == 2, part
    assert inside("<p>see <span class='ad-hoc'>q</span> z</p>") == "First.\nsee q z\nLast."
    assert inside("<p>see <span hidden>q</span> z <span style='display:none'>w <span>v</span></span>y</p>") == "First.\nsee z y\nLast."
    for part in ("<div class='ad'>Buy</div>", "<div class='ad-slot'>Buy</div>", "<div class='share-buttons'>Send</div>", "<div class='newsletterSignup'>Join</div>", "<aside>Side</aside>", "<div role='alert'>Cookies</div>",
                 "<div class='related'><a href='/a'>One more</a> <a href='/b'>and two</a></div>", "<ul class='menu'><li><a href='/'>Home</a></li></ul>", "<div hidden>no</div>"):
        assert inside(part) == "First.\nLast.", part
    # strings that distinct pages of a host share settle what is left in doubt
    notice = "This site keeps an archive of everything that was ever printed in the region, since 1901."
    own = "The soup of the day was made of beans, carrots and whatever else the garden had to give."
    pages = [(i, f"http://h/{i}", f"<body><article><p>Article {i} tells {own if i == 1 else i}</p><div class='widget'>{notice}</div><div class='menu-item'>{own if i == 2 else f'{i}{i} bowls served'}</div></article></body>") for i in range(1, 4)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: f"Article 1 tells {own}\n11 bowls served", 2: f"Article 2 tells 2\n{own}", 3: "Article 3 tells 3\n33 bowls served"}
