"""User agents with expectations written by hand, not taken from the rules."""

from adspark.operators import useragent as UA

# (user agent, browser, os, mobile, tablet, pc, bot)
CASES = [
    ("Mozilla/5.0 (Linux; Android 13; SM-G991B) AppleWebKit/537.36 (KHTML, like Gecko) SamsungBrowser/23.0 Chrome/115.0.0.0 Mobile Safari/537.36", "Samsung Internet", "Android", True, False, False, False),
    ("Mozilla/5.0 (Linux; Android 12; Lenovo TB-X606F) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/114.0.0.0 Safari/537.36", "Chrome", "Android", False, True, False, False),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Safari/537.36 OPR/105.0.0.0", "Opera", "Windows", False, False, True, False),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 16_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) FxiOS/118.0 Mobile/15E148 Safari/605.1.15", "Firefox iOS", "iOS", True, False, False, False),
    ("Mozilla/5.0 (Windows NT 6.1; WOW64; Trident/7.0; Tablet PC 2.0; rv:11.0) like Gecko", "IE", "Windows", False, False, True, False),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 16_0 like Mac OS X) AppleWebKit/605.1.15 Mobile/20A362 [FBAN/FBIOS;FBAV/390.0]", "Facebook", "iOS", True, False, False, False),
    ("Mozilla/5.0 (X11; CrOS x86_64 14541.0.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/118.0.0.0 Safari/537.36", "Chrome", "Chrome OS", False, False, True, False),
    ("Mozilla/5.0 (compatible; AhrefsBot/7.0; +http://ahrefs.com/robot/)", "Other", "Other", False, False, False, True),
    ("AdsBot-Google (+http://www.google.com/adsbot.html)", "Other", "Other", False, False, False, True),
    ("Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.6 Mobile/15E148 Safari/604.1", "Mobile Safari", "iOS", False, True, False, False),
    (None, "Other", "Other", False, False, False, False),
]


def test_fields(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, user_agent string")
    for method in ("inline", "distinct"):
        got = {r.id: (r.ua_browser, r.ua_os, r.ua_is_mobile, r.ua_is_tablet, r.ua_is_pc, r.ua_is_bot) for r in UA.ua_enrich(df, method=method).collect()}
        assert got == {i: c[1:] for i, c in enumerate(CASES)}


def test_rules_as_a_table(spark):
    rules = UA.rules_from(spark.createDataFrame([("shop", "App/2", "new", 1), ("shop", "App/", "old", 2)], "field string, pattern string, value string, priority int"), {"shop": "none"})
    df = spark.createDataFrame([("App/2.1",), ("App/1.0",), ("x",)], "user_agent string")
    assert [r.shop for r in UA.ua_enrich(df, rules=rules).collect()] == ["new", "old", "none"]
