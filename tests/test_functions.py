from pyspark.sql import functions as F

from satchel.functions import codes, texts, tokens, urls


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("r")).first()["r"]


def test_particles_one_attempt(spark):
    for text, want in [("쿠버네티스를", "쿠버네티스"), ("파이썬에서는", "파이썬"), ("나는", "나는"), ("서에서", "서에서"), ("(Go!)", "go"), ("...", "")]:
        assert one(spark, text, tokens.normalize_token) == want


def test_sentences(spark):
    split = lambda t: one(spark, t, tokens.split_sentences)
    assert split("One two. Three four! Five?") == ["One two.", "Three four!", "Five?"]
    assert split("It is 3.14 long. Dr. Smith came. e.g. this one.") == ["It is 3.14 long.", "Dr. Smith came. e.g. this one."]
    assert split("Wait... what is it. Yes.") == ["Wait... what is it.", "Yes."]
    assert split('He said "go." Then left.') == ['He said "go."', "Then left."]
    assert split("soft\nwrap goes on.\nNext line") == ["soft wrap goes on.", "Next line"]
    assert split("title\n\nBody text.") == ["title", "Body text."]


def test_prose(spark):
    assert one(spark, "This is a sentence that a person reads.", tokens.is_prose)
    assert not one(spark, "SponsoredSponsored is a glued advertisement text.", tokens.is_prose)
    assert not one(spark, "for (i = 0; i < n; i++) { x = y; } // done now.", tokens.is_prose)
    assert not one(spark, "no end of sentence in this line at all", tokens.is_prose)


def test_cap_bytes_keeps_code_points(spark):
    for text, n, want in [("abc", 2, "ab"), ("가나다", 7, "가나"), ("a😀b", 4, "a"), ("a😀b", 5, "a😀"), ("é", 1, ""), ("short", 99, "short")]:
        assert one(spark, text, lambda c, n=n: texts.cap_bytes(c, n)) == want


def test_entities(spark):
    for text, want in [("a &lt;b&gt; &amp;lt;", "a <b> &lt;"), ("&#65;&#x42;&#128512;", "AB😀"), ("&#0; &unknown;", "&#0; &unknown;")]:
        assert one(spark, text, texts.unescape_entities) == want


def test_walls_and_footers(spark):
    assert one(spark, "Please enable JavaScript to go on", lambda c: texts.is_blocked_page(F.lit(""), F.lit(""), c))
    assert not one(spark, "enable javascript " + "x" * 500, lambda c: texts.is_blocked_page(F.lit(""), F.lit(""), c))
    assert one(spark, "이용약관 개인정보처리방침 고객센터", texts.is_footer_only)


def test_urls(spark):
    assert one(spark, "HTTPS://User@WWW.Example.com:80/x", urls.host_of) == "www.example.com"
    assert one(spark, "www.a.b.co.kr", urls.host_suffixes) == ["a.b.co.kr", "b.co.kr", "co.kr"]
    assert one(spark, "https://blog.naver.com/a?b=c", urls.mobile_host_rewrite) == "https://m.blog.naver.com/a?b=c"
    for u, want in [("https://youtu.be/abc", True), ("https://m.youtube.com/watch?v=1", True), ("https://youtube.com/watch?x=1", False), ("https://youtu.be/", False)]:
        assert one(spark, u, urls.is_youtube_watch) is want
    for ref, want in [("/i.png", "https://a.com/i.png"), ("//b.com/i", "https://b.com/i"), ("i.png", "https://a.com/x/i.png"), ("http://c/i", "http://c/i")]:
        assert one(spark, ref, lambda c: urls.resolve_url(F.lit("https://a.com/x/y?z"), c)) == want


def test_codes(spark):
    for text, want in [("1700000000", 1700000000), ("1700000000000000", 1700000000), ("x", 0), ("-5", 0), (None, 0)]:
        assert one(spark, text, codes.add_date_seconds) == want
    for text, want in [("2024-01-31T00:00:00Z", 1706659200), ("2024-01-31T09:00:00+09:00", 1706659200), ("2024-01-31 00:00:00", 1706659200), ("2024-01-31", 1706659200), ("soon", None)]:
        assert one(spark, text, codes.parse_published) == want
    assert one(spark, 5, lambda c: codes.cursor_decode("list", codes.cursor_encode("list", c, c))["b"], "long") == 5
    assert one(spark, 5, lambda c: codes.cursor_decode("other", codes.cursor_encode("list", c, c)), "long") is None


def test_nfc(spark):
    df = spark.createDataFrame([("한",)], "c string")
    assert df.select(tokens.nfc(F.col("c"))).first()[0] == "한"


def test_entities_by_name_and_number(spark):
    cases = [("&times;&euro;&sect;&nbsp;", "×€§\u00a0"), ("&#0128512; &#x0041;", "😀 A"), ("&#150;&#x80;", "–€"), ("&amp;#65; &#38;lt;", "&#65; &lt;"), ("&#99999999999; &#xD800;", "&#99999999999; &#xD800;"), ("plain", "plain")]
    for text, want in cases:
        assert one(spark, text, texts.unescape_entities) == want


def test_particles_and_trigrams(spark):
    got = spark.createDataFrame([("가에서는 학교에서는 검색은 은",)], "t string").select(tokens.tokenize(F.col("t")).alias("x")).first().x
    assert got == ["가에서는", "학교", "검색", "은"]  # only the longest particle is tried, and two characters stay
    assert spark.createDataFrame([("aB😀é \n\t",)], "t string").select(tokens.trigrams(F.col("t")).alias("x")).first().x == ["ab😀", "b😀é", "😀é ", "é \n"]
    for short in (None, "", "ab"):
        assert spark.createDataFrame([(short,)], "t string").select(tokens.trigrams(F.col("t")).alias("x")).first().x == []
