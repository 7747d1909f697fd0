import pytest

from factorloom.llm import residue as r

ASKED = [
    "One more step. Please complete the security check to access example.com. Why do I have to complete a CAPTCHA? Completing the CAPTCHA proves you are a human and gives you temporary access to the web property.",
    "You must log in to continue. Forgot your password?",
    "Your session has expired. Please sign in to continue. Back to my account",
]
WRITTEN = [
    "Please sign in to continue is what the page says. How can I get rid of it?",
    "I get Fatal error: call to undefined function in a.b 2.17.1, but only for one widget. You need to close the loader before the loop starts. I expected 12 requests.",
    "Under maintenance mode the proxy should answer with 503, not 200, or caches will keep the page. There are two separate issues here.",
]


@pytest.mark.parametrize("text", ASKED)
def test_questions_of_a_site_are_no_veto(text):
    assert r.judge(text)[0] == 2


@pytest.mark.parametrize("text", WRITTEN)
def test_posts_about_messages(text):
    assert r.judge(text)[0] < 2


SLOTS = [
    "We received your payment of {amount} today.", "Thanks for order {OrderNumber}, it is on the way.", "The call failed with {ErrorCode} again.", "Dear {recipient}, just sort it first.",
    "Ask in the [DEPARTMENT] about it.", "It is at <street>, second floor.",
]
NO_SLOTS = [
    r"We write \frac{alpha}{beta} and $x_{max}$ and \begin{align} here, also \mathbb{Real}.", "Use the <Button> component with List<String> and #include <vector> in it.", "[SOLVED] It works [EDIT] now, see [GNU][1].",
    "The set {a} and the [sic] thing <grin> are fine.", "The element <project> is closed by </project> in the file.",
]


@pytest.mark.parametrize("text", SLOTS)
def test_slots_of_any_name(text):
    assert r.judge(text)[0] == 2


@pytest.mark.parametrize("text", NO_SLOTS)
def test_no_slots(text):
    assert r.judge(text)[0] < 2


LINKED = [
    "See [{{product}}](http://x.example) for it.", "Look at https://{{site_name}}/help for it.", 'Hello <a href="http://x.example/a">${first_name}</a>, thanks.', "See [this page](http://x.example/{{ page }}) for it.",
    'Click <a href="https://{{host}}/x">here</a> now.', "Unsubscribe at http://x.example/u?m=%USER_EMAIL% now.",
]


@pytest.mark.parametrize("text", LINKED)
def test_slots_in_links(text):
    assert r.judge(text)[0] == 2


def test_links_without_slots():
    assert r.judge('See [this page](http://a.example/b?x=%20y%20) and <a href="http://a.example/%7Bid%7D">that</a>, at http://a.example/users/{id}/posts.')[0] == 0


PAGES = [
    "Die Anwendung steht im Moment leider nicht zur Verfügung. Unsere Techniker führen gerade eine geplante Wartung durch. Die Seite wird voraussichtlich um 14 Uhr wieder erreichbar sein. Wir danken für Ihre Geduld; der Zugriff auf alle Bereiche dieser Website folgt danach, bitte kommen Sie später wieder. Vielen Dank.",
    "The application is resting at the moment. Our servers get new disks and the site is offline until the work is over. Every request is answered with this page until then. The incident team keeps the status page current. Access comes back step by step, login first. Please reload in an hour; nothing of your account is lost.",
]
TRACE = "HTTP Status 500 – Internal Server Error\n\nType Exception Report\nMessage Request processing failed\nDescription The server encountered an unexpected condition that prevented it from fulfilling the request.\n\n" + "\n".join(f"at com.acme.shop.Handler{i}.invoke(Handler{i}.java:{i + 10})" for i in range(60))
BLOCK = "Access to this site was denied. " + "The request was blocked by the security service of this site. Your browser sent a request that looked automated. If you believe this is a mistake, contact the site owner and give the incident number shown on this page. " * 6


@pytest.mark.parametrize("text", [TRACE, BLOCK])
def test_long_messages(text):
    assert len(text) > 900 and r.judge(text)[0] == 2


def test_a_long_post_with_a_message_in_it():
    assert r.judge("The loader reads each table once and keeps its rows by key. " * 20 + "Access was denied. " + "After that it sorts the keys and writes them. " * 20)[0] == 0


def test_copies_of_long_and_foreign_pages(spark):
    rows = [(10 * k + i, 100 + i, None, p, f"host{i}") for k, p in enumerate(PAGES) for i in range(5)]
    rows += [(100 + i, None, "How can I sort this list of the old page?", "It doesn't sort.", "host0") for i in range(5)]
    rows += [(200 + i, 100 + i, None, "Vielen Dank für die schnelle Antwort!", f"host{i}") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id bigint, question_id bigint, title string, text string, source string")
    assert sorted(x.doc_id for x in r.residue(d).collect()) == [*range(5), *range(10, 15)]
