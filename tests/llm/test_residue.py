import pytest

from factorloom.llm import residue as r

CASES = [
    "404 Not Found\n\nexample/1.2", "HTTP Status 503 – Service Unavailable\nMessage /a/b", "Error 404. La página solicitada no existe o ha sido movida.", "Ошибка 500. Страница не найдена.", "お探しのページは見つかりませんでした。",
    '{"error":{"code":503,"message":"service unavailable","trace":"ab12"}}', "<Error><Code>NoSuchKey</Code><Key>x</Key></Error>", "Your session has expired. Please sign in again to continue.", "We're down for maintenance and will be back shortly.",
    "☰ Menu\n\nPlease enable JavaScript to view this page.\n\n© 2021 someone", "Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.", "Example needs scripts to run. Turn it on in your web browser settings and reload.", "Please\nenable JavaScript to view\nthis page.",
    "We use cookies to give you the best experience. Accept all | Only necessary | Settings", "This question was removed by its author or is no longer available.", "upstream request timeout (c2ccdda4)", "Access to /a/b was denied. Reference no. 4e7bcfec.",
    "Lorem ipsum dolor sit amet. Consectetur justo tempor aute lectus lorem.", "How do I sort this list?\n\nNisi velit consectetur elit, aliqua pariatur ipsum aliqua vitae sed aute.", "asdf jkl; fjdk sldkfj aslkdjf", "test post. test post. test post.", "Texto de relleno. Aquí va el contenido de la respuesta.",
    "Dear {{ user.name }}, just sort it first.", "It works.\n\nBest regards,\n${site_name}", "Hello %FIRST_NAME%, thanks.", "Answer by *|EMAIL|* (Title.title.label points)", "Hola <insert company here>: gracias.", "Sent by [Your name] via &lt;company&gt;", "New replies for (user name goes here).", "Thanks, __PRODUCT__",
]
FINE = [
    "A 404 means that the route isn't registered; a 503 means that the server is down.", 'Why does my crawler only get "JavaScript is required" from the page?', 'How can I show visitors a message such as "Please enable JavaScript" when the tree needs it?',
    "The page then shows:\n\n```\nSomething went wrong on our end. Our team has been told.\n```\n\nHow do I get rid of it?", "In one the placeholder syntax is `{{ author }}`, while the other expects `<<FirstName>>`.", "You forgot to fill `[insert version]` before sending.",
    "To test the layout of the printer I need three paragraphs of lorem ipsum. Does it ship a generator?", "Use a template:\n\n    <p>{{ name }}</p>\n\nThat is all.", "<pre><code>for f in ${DIR}/*.log; do\n</code></pre>\nThis works.", "See [this page](http://a.example/b).", "It ends. <|endoftext|>",
    "👍", "thx, solved", "Rebuild it. Done.", "I measured 57 ms instead of 300 ms.", "* tujo_harcoval: 19,631\n• lun_cofi: 816", "My session has expired twice today because the clock of the server is wrong; how can I see which one it is?", "", "   \n ", "It was explained at http://a.example/x, but the page has moved.",
    "Turn JavaScript off in the test browser, then the widget falls back to plain HTML.",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert r.judge(text)[0] == 2


@pytest.mark.parametrize("text", FINE)
def test_posts(text):
    assert r.judge(text)[0] < 2


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, question_id bigint, title string, text string, source string, said string, level int")


def test_operator(spark):
    hint = "Login blocked, contact the account team"
    rows = [(i, None, None, t, "a", "", 0) for i, t in enumerate([CASES[0], None, "", "  ", FINE[0], CASES[0]])]
    rows += [(10 + i, 100, None, hint, s, "", 0) for i, s in enumerate(["a", "b", "b"])]
    rows += [(20 + i, 101, None, "Request denied by account number 7", s, "", 0) for i, s in enumerate(["a", "b", "c"])]
    rows += [(100, None, "Sorting a list", "How do I sort?", "a", "", 0), (101, None, "Request denied, why?", "Why?", "a", "", 0)]
    rows += [(30, 100, None, "Server moved, page redirected", "a", "", 0)]
    got = sorted(x.doc_id for x in r.residue(table(spark, rows)).collect())
    assert got == [0, 5, 10, 11, 12]  # copies of a hint on several hosts, unless it's what the question is about
    assert r.residue(table(spark, rows).limit(0)).count() == 0


def test_very_long_text():
    assert r.judge("word and more. " * 200_000)[0] == 0
    assert r.judge("word and more. " * 20_000 + "\n\nBest regards,\n{{name}}")[0] == 2
