"""Texts that are left-overs of a site or a template instead of a post: error pages, notices, filler, slots that were never filled.

Of each text, what is shown rather than said (code, quotations, links) and the furniture of pages is taken away. Placeholder detectors look at the rest: filler
by paragraph, slots anywhere in the prose. Messages of sites and notices are found by combined evidence. Wording is one part of it: sentences that read as a
message, words that hint at one, or words that this corpus uses in messages above all. The others come from the corpus: the terms of the rest against those
of the title and the tags of its question, the number of records that say the same up to names and numbers, and the number of hosts (sources) they are on.
No part is enough by itself.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table

#: Copies count when so many records of so many hosts say the same.
COPIES, HOSTS = 3, 2
#: Weight of wording that reads as a message, and of mere hints; what a record needs. Copies, hosts and a title about something else add one each.
READS, HINTS, NEEDED = 3, 1, 4
#: Terms of messages learned from the corpus: records of messages that have it, share of its records, and the most that are kept.
TERM_RECORDS, TERM_SHARE, TERMS = 3, 0.5, 5000
#: Terms of a task whose counts are held before they are passed on.
HELD_TERMS = 200_000
#: Characters from which a rest counts as long: it must begin as a message or consist of them, and may share some words with a title by chance.
LONG_CHARS, SHORT_CHARS = 900, 200

# --- what is shown, not said -------------------------------------------------------------------------------------------------------------------

CODE = re.compile(r"(?s:(?:```|~~~).*?(?:```|~~~|\Z)|<pre\b.*?(?:</pre\s*>|\Z)|<code\b.*?(?:</code\s*>|\Z)|`[^`]{1,200}`)|^(?:[ \xa0]{4,}|(?:&nbsp;){4,}|\t)\S.*$|^[ \xa0]{0,3}>\s.*$", re.M | re.I)
QUOTED = re.compile(r'(?<![\w=])"[^"\n]{2,300}"(?!\w)|“[^”\n]{2,300}”|„[^“”\n]{2,300}[“”]|「[^」\n]{2,300}」')
LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\s]*\)|https?://\S+|<a\b[^>]*>.*?</a>", re.S | re.I)
TAGS = re.compile(r"</?(?:p|div|span|br|hr|b|i|u|em|strong|ul|ol|li|blockquote|h[1-6]|html|head|body|center|title|table|tr|td|th|noscript|img|nav|header|footer|main|section|sup|sub|small|kbd)\b[^<>]*>", re.I)
FURNITURE = re.compile(
    r"""^\W*(?:
    menu|skip\ to\ (?:main\ )?content|log\ ?in(?:\W+(?:sign\ up|register))?|sign\ (?:in|up)|register
    |(?:home|questions|tags|users|help|contact|terms|privacy|about|jobs|imprint|cookies|settings|faq)(?:\W+(?:home|questions|tags|users|help|contact|terms|privacy|about|jobs|imprint|cookies|settings|faq|of\ use|policy|us))+
    |back\ to\ (?:top|all\ \w+|the\ \w+)|[\w.-]+\ [–-]\ questions\ and\ answers|ray(?:\ id)?\W*[0-9a-f]{6,}|(?:©|\(c\)|copyright)\W*(?:\d{4})?.{0,60}|powered\ by\ .{0,40}|all\ rights\ reserved\W*|[☰≡]\s*\w*
    )\W*$""",
    re.I | re.X | re.M,
)

# --- messages of sites -------------------------------------------------------------------------------------------------------------------------

STATUS = r"(?:bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|request time-?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
SCRIPT = r"(?:java\s?scripts?|js|scripts?|scripting|cookies?)"
AGENT = r"(?:(?:web )?browser|device)"
STRONG = [
    rf"^\W*(?:http )?(?:status |error |code )*[45]\d\d\W+(?:error\W+)?{STATUS}",
    rf"\b(?:http status|error|fehler|erreur|errore?|erro|ошибка|エラー|错误)\W{{0,3}}[45]\d\d\b",
    r"^\W*[45]\d\d\s*(?:错误|エラー|ошибка|fehler|erreur|error)",
    r"^\W*\{\s*\"(?:error|errors|status|message|code)\"\s*:.*\}\W*$",
    r"<error>\s*<code>.*?</code>",
    r"\bunhandled exception while\b|\bfatal error\W+(?:call to|uncaught|allowed memory|maximum execution)|\bsee the server log\b|\bcannot connect to (?:the )?database\b|\berror establishing a database\b|^\W*traceback \(most recent",
    r"\bupstream (?:request timeout|connect error)\b|\bno healthy upstream\b|\bno server is available to handle\b",
    r"\brequested url\b.{0,200}\bnot found\b|\bnot found on this server\b|\b(?:couldn.?t|could not|can.?t|cannot) find (?:the|that|this) page\b|\bpage (?:you .{0,40})?(?:was |is |could ?n.t be |cannot be )?not (?:be )?found\b|\bpage (?:does not|doesn.t|no longer) exists?\b",
    r"\bp[áa]gina (?:solicitada |que busca )?no (?:existe|encontrada|se encuentra)\b|\bp[áa]gina n[ãa]o (?:encontrada|existe)\b|\bseite (?:wurde |konnte )?nicht gefunden\b|\bpage (?:est )?introuvable\b|\bpage demandée\b.{0,40}\b(?:existe|trouv)|страница не найдена|ページは?見つかりません|ページが見つかりません|页面不存在|找不到(?:该)?页面|无法处理您的请求",
    r"\baccess (?:to .{1,200} )?(?:was|is|has been)? ?denied\b|\byou (?:do not|don.t) have permission to (?:access|view)\b|\bif you believe this is a mistake\b|\bzugriff verweigert\b|\bacc[eè]s (?:refusé|interdit)\b|\bacceso denegado\b|\bacesso negado\b|доступ (?:запрещ|закрыт)|アクセスが拒否|拒绝访问",
    r"\b(?:question|post|answer|page|content|entry|topic|thread|account)\b.{0,40}\b(?:was|has been|is) (?:removed|deleted|withdrawn|suspended|closed) by\b|\bis no longer available\b.{0,40}$|\bhas been (?:removed|deleted)\b.{0,60}$",
    r"\bdown for (?:scheduled |planned )?maintenance\b|\bunder(?:going)? maintenance\b(?! mode)|\bbe back (?:shortly|soon)\b|\btemporarily (?:unavailable|down|out of service)\b|\bvor[üu]bergehend nicht (?:erreichbar|verf[üu]gbar)\b|\bune erreur est survenue\b|\bse ha producido un error\b|\bocorreu um erro\b|\bein fehler ist aufgetreten\b|произошла ошибка|временно недоступ|エラーが発生しました|メンテナンス中|(?:系统|网站)?维护中|暂时无法|\btemporairement indisponible\b|\bno disponible temporalmente\b|\btemporariamente indispon",
    r"\b(?:something|that) went wrong\b|\bour team has been (?:told|notified)\b|\bplease try again (?:later|in a few)\b|\btry again in a few minutes\b",
    r"\bsession (?:has |was )?(?:expired|timed out)\b|\bplease (?:sign|log) ?in (?:again )?to\b|\b(?:must|need to|have to) (?:be (?:signed|logged) in|sign in|log in)\b|\bsitzung ist abgelaufen\b|\bsession a expir|\bsesi[óo]n ha (?:caducado|expirado)|\bsess[ãa]o expirou|сессия (?:истекла|закончилась)|会话已过期|セッションの?(?:有効)?期限|请(?:先)?登录|ログインしてください|\bbitte melden sie sich\b|\bveuillez vous (?:re)?connecter\b",
    r"\bsent too many requests\b|\btoo many requests\b.{0,80}$|\bunusual traffic\b|\brate limit(?:ed| exceeded)\b.{0,60}\btry again\b",
    rf"\b(?:enable|activate|allow|accept|turn on|switch on|unblock)\b.{{0,20}}\b{SCRIPT}\b|\b{SCRIPT}\b.{{0,40}}\b(?:(?:is|are|has been|seems? to be|must be|to be) )?(?:required|disabled|switched off|turned (?:on|off)|blocked|not (?:enabled|supported)|needed)\b",
    rf"\b(?:needs?|requires?)\b.{{0,12}}\b{SCRIPT}\b|\b{SCRIPT}\b could not be loaded|\bcontent blocked\b.{{0,10}}\b{SCRIPT}\b|\bnecessary to have {SCRIPT}\b",
    rf"\bwe (?:and our partners )?use cookies\b|\bthis (?:web)?site uses cookies\b|\b(?:your|this) {AGENT} is (?:not supported|out of date|outdated|too old)\b|\bupgrade (?:to a newer one|your browser)\b|\bunsupported browser\b",
    rf"\bchecking your {AGENT}\b|\byou are (?:not a robot|human|not a bot)\b|\bverify (?:that )?you are\b|\bprove (?:that )?you are human\b|\bcomplet(?:e|ing) the (?:puzzle|captcha|security check)\b|\bsecurity check\b.{{0,40}}\b(?:access|continue)",
    rf"\b(?:aktivieren|erlauben) sie\b.{{0,20}}\b{SCRIPT}\b|\b{SCRIPT}\b.{{0,40}}\b(?:erlaubt|aktiviert) (?:sein|werden)|\bactiver?\b.{{0,10}}\b{SCRIPT}\b|\b(?:activa|active|habilite|habilita|ative|attiva)\b.{{0,10}}\b{SCRIPT}\b|включите\s*{SCRIPT}|启用\s*{SCRIPT}|(?:{SCRIPT}|クッキー)\s*を有効に|\bcookies (?:zulassen|akzeptieren|accepter|aceptar)\b",
]
STRONG = [re.compile(p, re.I | re.S) for p in STRONG]
HINT = re.compile(r"\b(?:error|unavailable|expired|denied|blocked|verify|enabled?|disabled|supported|upgrade|retry|reload|loading|redirect(?:ing|ed)?|moved|removed|deleted|login|logged|sign(?:ed)? in|browser|page|site|request|server|maintenance|incident|cookies?|captcha|robot|human|later|javascript|access|permission|account|subscribe)\b", re.I)

BREAK = re.compile(r"(?<=[.!?…。！？])\s+|(?<=[。！？])|\n|\s[|·]\s")
#: Frames of a stack trace, as error pages show them.
TRACE = re.compile(r"\bat [\w.$<>/@]+\([^()]{0,120}\)|\bFile \"?[^\s\",]+\"?, line \d+(?:, in \S+)?|#\d+ \S+\(\d+\): \S+")
HINT_ELSEWHERE = re.compile(
    r"""\b(?:fehler|wartung\w*|erreichbar|verfügbar|gesperrt|anmelden|abgelaufen|zugriff|seite|website|später|techniker|störung
    |erreur|maintenance|indisponible|accès|connexion|expirée?|plus\ tard|navigateur|serveur|réessayer
    |errore?s?|mantenimiento|disponible|acceso|página|sesión|navegador|servidor|más\ tarde|servicio|sitio
    |erros?|manutenção|indisponível|acesso|sessão|servidor|mais\ tarde|serviço|manutenzione|pagina|accesso|servizio|più\ tardi
    |fout|onderhoud|beschikbaar|toegang|pagina|later|dienst|błąd|konserwacja|niedostępn\w+|dostęp|strona|serwis|później|hata|bakım\w*|erişim|sayfa|daha\ sonra
    |ошибка|обслуживани\w+|недоступ\w+|доступ|страниц\w+|сервер\w*|позже|сайт\w*|войдите|технически\w+)\b|エラー|メンテナンス|アクセス|ページ|ログイン|サーバー|しばらく|サイト|ご利用|错误|維護|维护|访问|页面|登录|服务器|稍后|网站|오류|점검|접속|페이지|로그인|서버|나중에|사이트""",
    re.I | re.X,
)
#: What somebody writes about a message: first person and questions, but not a site's own buttons ("my account", "I am human") or questions to its reader.
ASKS = re.compile(
    r"\b(?:how (?:can|do|to)|why (?:does|do|is)|what (?:is|does)|i (?:get|see|have|need|want|tried|expected|am(?! (?:human|not a|over|an adult|at least)\b))|my\b(?! (?:accounts?|profile|orders?|cart|settings)\b)|we have)\b",
    re.I,
)
TO_READER = re.compile(r"\byou(?:r|rs)?\b", re.I)
#: A character of such a sentence weighs as so many of a message.
TALK_WEIGHT = 3

# Of each pattern of STRONG some text, in lower case, that it can't do without; a text with none of them isn't searched for it.
SIGNS = [
    "bad forbid unauthor payment found allowed time-out timeout conflict gone many internal implemented gateway unavailable",
    "http error fehler erreur erro ошибка エラー 错误",
    "错误 エラー ошибка fehler erreur error",
    "{",
    "<error>",
    "unhandled exception|fatal error|server log|database|traceback",
    "upstream",
    "url server find page",
    "página pagina seite page страница ページ 页面 请求",
    "denied permission mistake zugriff acc acceso acesso доступ アクセス 拒绝",
    "removed deleted withdrawn suspended closed available",
    "maintenance be_back temporarily vorübergehend vorubergehend erreur error erro fehler ошибка недоступ エラー メンテナンス 维护 暂时 temporairement temporalmente",
    "wrong notified told try",
    "session sitzung sesi sessão sessao sign_in signed_in signin log_in login logged_in сессия 会话 セッション 登录 ログイン anmelden connecter melden",
    "requests traffic rate",
    "enable activate allow accept turn switch unblock required disabled blocked supported needed",
    "need require loaded blocked necessary",
    "cookies browser device upgrade",
    "checking robot human bot puzzle captcha security",
    "aktivieren erlauben erlaubt aktiviert activ habilit ativ включите 启用 有効 cookies",
]
SIGNS = [{y.replace("_", " ") for y in (x.split("|") if "|" in x else x.split())} for x in SIGNS]
ALL_SIGNS = sorted(set().union(*SIGNS))
#: The same for filler, for the rests of furniture, and for hints in other languages.
FILLER_SIGNS = "sample text|dummy|placeholder|your own|filled|a heading for|content for|coming soon|lorem ipsum|remplissage|relleno|preenchimento|blindtext|fülltext|platzhalter|текст|ここ|ダミー|此处|在此|这里|占位|aquí va|aqui vai|hier steht|votre texte|todo|tbd".split("|")
FRAME_SIGNS = "skip to|menu|log in|login|– questions|back to|help ·|home |©|ray ".split("|")
ELSEWHERE_SIGNS = """fehler wartung erreichbar verfügbar gesperrt anmelden abgelaufen zugriff seite website später techniker störung erreur indisponible disponible accès connexion expiré plus_tard navigateur serveur réessayer
    errore errors errori erros erro, erro. erro: mantenimiento acceso página pagina sesión navegador servidor más_tarde servicio sitio erro_ manutenção indisponível acesso sessão mais_tarde serviço manutenzione accesso servizio più_tardi
    fout onderhoud beschikbaar toegang dienst błąd konserwacja niedostępn dostęp strona serwis później hata bakım erişim sayfa daha_sonra ошибка обслуживани недоступ доступ страниц сервер позже сайт войдите технически
    エラー メンテナンス アクセス ページ ログイン サーバー しばらく サイト ご利用 错误 維護 维护 访问 页面 登录 服务器 稍后 网站 오류 점검 접속 페이지 로그인 서버 나중에 사이트"""
ELSEWHERE_SIGNS = [x.replace("_", " ") for x in ELSEWHERE_SIGNS.split()]
ECHOED = "qwert asdf dummy test bla foo xxx sample lorem text placeholder filler yxcv zxcv abc".split()


def has_sign(low: str, signs: list[str]) -> bool:
    for x in signs:
        if x in low:
            return True
    return False


# --- filler ------------------------------------------------------------------------------------------------------------------------------------

# Words of the usual dummy Latin.
LATIN = frozenset(
    """a ac ad adipiscing adipisicing aenean aliqua aliquam aliquet aliquip amet anim ante arcu at auctor augue aute cillum commodo condimentum consectetur
    consequat convallis cras culpa cupidatat curabitur cursus deserunt diam dictum dis do dolor dolore donec dui duis ea egestas eget eiusmod eleifend
    elementum elit enim erat eros esse est et etiam eu ex excepteur exercitation felis fugiat fusce gravida id in incididunt integer ipsum irure justo
    labore laboris lacus lectus leo lorem maecenas magna massa metus mi minim mollis mollit morbi nam nec neque nisi nisl non nostrud nulla nullam nunc
    occaecat odio officia orci pariatur porta praesent pretium proident purus quam qui quis quisque reprehenderit risus sagittis sapien sed sem semper
    sint sit sunt suspendisse tellus tempor tempus tincidunt tortor turpis ullamco ultrices urna ut varius vel velit veniam vitae vivamus viverra
    voluptate""".split()
)
SHORT_LATIN = frozenset("a ac ad at do ea est et eu ex id in mi nam non qui sem sit ut leo class dis sed at".split())
HOME_ROW = frozenset("asdfghjkl;")
FILLER = re.compile(
    r"""\bthis\ is\ (?:a\ )?(?:sample|dummy|placeholder|filler)\ (?:text|post|answer|content)\b|\breplace\ (?:it|this)\ with\ your\ own\b|\bmore\ sample\ text\b|\b(?:dummy|placeholder|sample)\ (?:answer|question|post)\b\W
    |\bplaceholder\ (?:copy|text)\ (?:will|to)\b|\bwill\ be\ filled\ (?:in\ )?later\b|\ba\ heading\ for\ this\ section\b|\btype\ (?:the\ details\ of\ )?your\ (?:question|answer|text|post)\b.{0,12}\bhere\b|\b(?:your|enter|insert|write|put)\ (?:your\ )?(?:text|content|answer|question)\ (?:goes\ )?here\b
    |\bcontent\ for\ this\ (?:entry|page|section)\ has\ not\b|\bcoming\ soon\b.{0,20}\bcontent\b|\blorem\ ipsum\ dolor\b
    |\btexte\ de\ remplissage\b|\btexto\ de\ (?:relleno|preenchimento)\b|\b(?:ein\ |ist\ )?(?:blindtext|fülltext|platzhaltertext)\b|здесь\ будет\ текст|текст[\ -]заполнитель|ここに(?:本文|テキスト|内容)を?入力|ダミーテキスト|(?:此处|在此|这里)(?:输入|填写|是)?(?:正文|文字|文本|内容)|占位(?:符)?文[本字]|aquí\ va\ el\ contenido|aqui\ vai\ o\ (?:conteúdo|texto)|hier\ steht\ (?:ihr|dein|der)\ text|votre\ texte\ ici
    """,
    re.I | re.X | re.M,
)
TODO = re.compile(r"^\W*(?:todo\W+(?:describe|paste|write|add|fill|insert)\b|tbd\W*$)", re.I | re.M)
REPEATED = re.compile(r"^\W*((?:\w+\W+){0,3}?\w*(?:qwert|asdf|dummy|test|bla|foo|xxx|sample|lorem|text|placeholder|filler|yxcv|zxcv|abc)\w*(?:\W+\w+){0,2}?)(?:\W+\1)+\W*$", re.I)

# --- slots -------------------------------------------------------------------------------------------------------------------------------------

NAME = r"(?:[A-Za-z][A-Za-z_]*(?:[. -][A-Za-z_]+){0,3})"
SLOT = re.compile(
    rf"""\{{\{{\{{?\s*[^{{}}\n]{{1,60}}?\s*\}}\}}\}}?|[$\#]\{{\s*[^{{}}]{{1,60}}\}}|\{{\$?\s*{NAME}\s*\}}|\{{\d{{1,2}}\}}|\*\|\s*[^|*]{{1,60}}\|\*|\[\[\s*[^\[\]]{{1,60}}\]\]|<%[=-]?\s*[^%<>]{{1,60}}%>|\{{%\s*[^%{{}}]{{1,60}}%\}}
    |«\s*{NAME}\s*»|<<\s*{NAME}\s*>>|(?<![\w%])%{NAME}%(?!\w)|%\({NAME}\)[sd]|(?<![\w$])\${NAME}\$(?!\w)|@@\s*{NAME}\s*@@|(?<!\w)__[A-Z][A-Z_]*?__(?!\w)|(?<![\w~])~[A-Z][A-Z_]*~(?![\w~])
    |<\s*(?:insert\s)?[A-Za-z][A-Za-z_]*(?:\s[A-Za-z_]+){{0,2}}(?:\shere)?\s*>|\[\s*[A-Z][A-Z_ ]{{2,40}}\](?!\()|\[\s*(?:your|insert|enter|add|type)\s[^\[\]]{{1,40}}\](?!\()|\(\s*[a-z_ ]{{1,40}}\sgoes\shere\s*\)|\b[A-Za-z]\w*\.\w+\.label\b""",
    re.X | re.I,
)
#: Slots that may be in an address; single braces, percent signs and dollars have other meanings there.
IN_ADDRESS = re.compile(r"\{\{\{?\s*[^{}\n]{1,60}?\s*\}\}\}?|[$#]\{\s*[^{}]{1,60}\}|\*\|\s*[^|*]{1,60}\|\*|\[\[\s*[^\[\]]{1,60}\]\]|<%[=-]?\s*[^%<>]{1,60}%>|\{%\s*[^%{}]{1,60}%\}|%[A-Z]+(?:_[A-Z]+)+%")
OPENING = re.compile(rf"<a\b(?:{IN_ADDRESS.pattern}|[^>])*>", re.I)
#: A link whose address may have spaces within slots.
SLOT_LINK = re.compile(rf"!?\[([^\]\n]*)\]\((?:{IN_ADDRESS.pattern}|[^)\s])*\)|https?://(?:{IN_ADDRESS.pattern}|\S)+|<a\b(?:{IN_ADDRESS.pattern}|[^>])*>.*?</a>", re.S | re.I)
#: What every slot has in some form; texts without it need no closer look.
MARKS = re.compile(r"[{$\[<%«~]|\*\||@@|__|&[lg#]|goes\s+here|\.label", re.I)
ELEMENTS = frozenset("a abbr article aside audio b blockquote body br button canvas caption center cite code col dd del details dfn div dl dt em embed fieldset figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param pre q s samp script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split())
SLOT_WORDS = frozenset("date name user username first last product company author email mail topic title link url city country version order number code error site sitename address phone subject id text content firstname lastname".split())

#: Words in brackets that are marks of a text or of a log, not names of something to fill in.
MARKERS = frozenset("edit edited update updated solved closed duplicate note notes sic todo tbd wip fixme info warn warning error debug trace fatal fail failed pass passed done deleted removed snip grin sigh spoiler endoftext unk pad mask sep cls eos bos".split())
#: What follows a name in brackets that is spoken of.
SHOWN = re.compile(r"\s*(?:tags?|elements?|components?|nodes?|attributes?|placeholders?|blocks?|sections?|syntax|types?)\b", re.I)


SPACES, WORDY, PARAGRAPH = re.compile(r"[ \t\n]+"), re.compile(r"\w"), re.compile(r"\n\s*\n")
TITLE = re.compile(r"<title>.*?</title>", re.S | re.I)
IN_QUOTES = re.compile(r'(?<![\w=])"[^"]{2,300}"(?!\w)')
FRAME = re.compile(
    r"^(?:skip to main content|[☰≡] ?menu|log ?in sign up|[\w.-]+ – questions and answers)\s+|\s+(?:back to (?:top|all \w+)|help · contact · terms|home \| questions \| tags(?: \| users)?|© \d{4}.{0,40}|ray [0-9a-f]{6,})$",
    re.I,
)
WORD = re.compile(r"[^\W\d_]+")
WRITE_HERE = re.compile(r"(?:text|content|answer|question|post)s?\b.{0,14}\bhere\b", re.S)
#: Ten keys of the home row, which a mash of them with 3 % of others must have somewhere.
HOME_RUN = re.compile(r"(?:[asdfghjkl;]\s*){10}")


def said(text: str) -> str:
    """The prose of a text: no code, no lines quoted from elsewhere."""
    return CODE.sub("\n", text.replace("\r\n", "\n").replace("​", ""))


def rest(prose: str) -> str:
    """What a text says apart from the furniture of its page, in one line."""
    t = html.unescape(prose).replace("\xa0", " ")
    if "<" in t:
        t = TITLE.sub(" ", t)
    t = LINK.sub(r"\1", t)
    if "<" in t:
        t = TAGS.sub("\n", t)
    t = FURNITURE.sub("", t)
    t = SPACES.sub(" ", t).strip()
    if not has_sign(t.lower(), FRAME_SIGNS):
        return t
    return FRAME.sub("", t)


def opened(m: re.Match) -> str:
    """What a link shows, and of its address the parts that are a slot beyond doubt."""
    x = m.group()
    if x[:2].lower() == "<a":
        head = OPENING.match(x).end()
        shown, address = re.sub(r"</a>$", "", x[head:], flags=re.I), x[:head]
    else:
        shown, address = m.group(1) or "", x
    return " ".join([" ", shown, *IN_ADDRESS.findall(address), " "])


def slots(prose: str) -> bool:
    """True if the prose has a slot or label key that was never filled."""
    if not MARKS.search(prose):
        return False
    t = " ".join(prose.replace("&nbsp;", " ").split())
    t = SLOT_LINK.sub(opened, t)
    if not MARKS.search(t):
        return False
    t = html.unescape(t)
    t = IN_QUOTES.sub(" ", t)
    for m in SLOT.finditer(t):
        x, before, after = m.group(), t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 20]
        words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|_", " ", x.strip("<>[]{} $")).lower().split()
        named = bool(set(words) & SLOT_WORDS)
        if x[0] == "<" and not x.startswith(("<%", "<<")):
            inserted = bool(words) and words[0] in ("insert", "your", "enter")
            if not words or (words[0] in ELEMENTS and not (words[0] in SLOT_WORDS and len(words) == 1 and f"</{words[0]}" not in t.lower())):
                continue
            if not (named or inserted) and (len("".join(words)) < 3 or re.search(r"[\w<]$|\binclude\s*$", before) or f"</{x[1:-1].strip().lower()}" in t.lower() or SHOWN.match(after) or words[0] in MARKERS):
                continue
        elif x[0] == "[" and not x.startswith("[[") and not re.match(r"\[\s*(?:your|insert|enter|add|type)\s", x, re.I):
            if not named and (x != x.upper() or len("".join(words)) < 4 or set(words) & MARKERS or re.search(r"\w$", before) or re.match(r"\s*[\[(:]", after)):
                continue
        elif x[0] == "{" and x[1] not in "{%$" and not x[1].isdigit() and not named:
            if len("".join(words)) < 3 or re.search(r"\\[A-Za-z]+\*?(?:\{[^{}]*\}|\[[^\[\]]*\])*$|[\^_}\w]$", before) or before.count("$") % 2 or SHOWN.match(after):
                continue
        return True
    return False


def filler(prose: str) -> bool:
    """True if a paragraph is filler."""
    t = html.unescape(prose).replace("\xa0", " ")
    t = TAGS.sub("\n\n", LINK.sub(" ", t))
    bare = QUOTED.sub(" ", t)
    low = bare.lower()
    if (has_sign(low, FILLER_SIGNS) or "here" in low and WRITE_HERE.search(low)) and (TODO.search(bare) or FILLER.search(SPACES.sub(" ", bare))):
        return True
    latin_words = sum(w in LATIN and w not in SHORT_LATIN for w in WORD.findall(low))
    if latin_words < 3 and not any(low.count(x) > 1 for x in ECHOED) and not HOME_RUN.search(low):
        return False
    for p in [*PARAGRAPH.split(bare), bare]:
        words = WORD.findall(p.lower())
        if latin_words >= 3 and len(words) >= 5:
            latin = sum(w in LATIN for w in words)
            if latin >= 0.7 * len(words) and sum(w in LATIN and w not in SHORT_LATIN for w in words) >= 0.5 * len(words):
                return True
        flat = "".join(p.lower().split())
        if len(flat) >= 10 and sum(c in HOME_ROW for c in flat) >= 0.97 * len(flat) and len(set(flat)) >= 4:
            return True
        if REPEATED.match(" ".join(p.split())):
            return True
    return False


def message(r: str) -> bool:
    """True if the rest of a text is a message of a site or a notice, and nothing else worth the name."""
    low = r.lower()
    there = {x for x in ALL_SIGNS if x in low}
    likely = [p for p, signs in zip(STRONG, SIGNS) if not signs.isdisjoint(there)]
    if not likely:
        return False
    if r.startswith("{") and STRONG[3].search(r):
        return True
    bare = " ".join(TRACE.sub(" ", QUOTED.sub(" ", r)).split())
    hits = [m for p in likely if (m := p.search(bare))]
    if not hits:
        return False
    parts, at = [], 0
    for s in BREAK.split(bare):
        at = bare.index(s, at)
        if WORDY.search(s):
            parts.append((at, at + len(s), s, asks(s)))
        at += len(s)
    hits = [m for m in hits if not any(asked and a < m.end() and m.start() < z for a, z, _, asked in parts)]
    if not hits:
        return False
    if len(bare) > LONG_CHARS and hits[0].start() >= SHORT_CHARS:
        return sum(len(s) for _, _, s, asked in parts if not asked and any(p.search(s) for p in likely)) >= 0.5 * len(bare)
    about = sum(len(s) for _, _, s, asked in parts if not asked and (any(p.search(s) for p in likely) or len(HINT.findall(s)) >= 2))
    about = max(about, max(m.end() - m.start() for m in hits))
    talk = sum(len(s) for _, _, s, asked in parts if asked)
    return about >= TALK_WEIGHT * talk and (len(bare) <= 160 or about >= 0.4 * len(bare) or hits[0].start() < 5 and len(bare) < 300)


def asks(r: str) -> bool:
    """Somebody writes about such a thing: in the first person, or with a question that isn't put to the reader."""
    return bool(ASKS.search(r)) or r.rstrip().endswith("?") and not TO_READER.search(r)


ODD = re.compile(r"[\d/_]")


def template(r: str) -> str:
    """What a text says, up to what differs between copies of a message: numbers, identifiers, paths and addresses."""
    return " ".join("#" if ODD.search(w) else w for w in r.lower().split())


def judge(text: str) -> tuple[int, str]:
    """(2: residue by its own wording, 1: hints of it, 0: none; what the text says up to names and numbers).

    The second is empty for slots and filler, which need no other evidence, and for texts in which somebody asks or tells something."""
    prose = said(text)
    if not WORDY.search(prose):
        return 0, ""
    if slots(prose) or filler(prose):
        return 2, ""
    r = rest(prose)
    if message(r):
        return 2, template(r)
    linked = bool(LINK.search(prose))
    if hints(r, linked):
        return 1, template(r)
    return 0, "" if linked or asks(r) else template(r)


def hints(r: str, linked: bool) -> bool:
    """True if most of a rest of any size is sentences with words of messages, in the languages known here, and nothing is asked or told in the first person.

    A short text with a link says where something is; in a longer one a link is as likely part of a page."""
    short = len(r) <= SHORT_CHARS
    if short and (linked or asks(r)):
        return False
    known = HINT_ELSEWHERE if has_sign(r.lower(), ELSEWHERE_SIGNS) else None
    found = {x.lower() for x in HINT.findall(r)}
    if len(found) < 2 and (known is None or len(found | {x.lower() for x in known.findall(r)}) < 2):
        return False
    if short:
        return True
    parts = [s for s in BREAK.split(TRACE.sub(" ", r)) if WORDY.search(s)]
    total, about, talk = sum(map(len, parts)), 0, 0
    for s in parts:
        if asks(s):
            talk += len(s)
            if TALK_WEIGHT * talk > total - talk:
                return False
    left = total - talk
    for s in parts:
        if not asks(s):
            if HINT.search(s) or known is not None and known.search(s):
                about += len(s)
            else:
                left -= len(s)
                if left < max(0.5 * total, TALK_WEIGHT * talk):
                    return False
    return about >= 0.5 * total and about >= TALK_WEIGHT * talk


def terms(said: str) -> set[str]:
    return {w for w in WORD.findall(said) if len(w) > 3 or w > "\u2e80"}


def evidence(docs: DataFrame, copies: int = COPIES, hosts: int = HOSTS) -> DataFrame:
    """(doc_id, kind, wording, n_copies, n_hosts, apart, score) of every record that its wording, or its copies and the words of messages in this corpus, make suspect.

    kind: 'placeholder' (slots, filler; no other evidence is needed, score NEEDED) or 'message'. wording: READS, HINTS, also for texts whose terms the corpus
    uses in messages above all. apart: the title and tags of the question are about something else, or there are none. Records of one host say the same
    as often as they like: copies count with ``hosts`` of them. Null, empty and blank texts are never suspect; docs: doc_id, question_id, title, text, source, tags (optional)."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, list[int]] = {}
        names = ["doc_id", "level", "said", "term", "n", "m"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]

        def flush() -> pa.RecordBatch:
            none = [None] * len(count)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([none, none, none, list(count), [v[0] for v in count.values()], [v[1] for v in count.values()]], kinds)], names)
            count.clear()
            return out

        for b in batches:
            found = [judge(t) for t in b.column(1).to_pylist()]
            for level, said in found:
                if said:
                    for w in terms(said):
                        c = count.setdefault(w, [0, 0])
                        c[0] += 1
                        c[1] += level == 2
            none = [None] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip([[f[0] for f in found], [f[1] for f in found], none, none, none], kinds[1:]))], names)
            if len(count) > HELD_TERMS:
                yield flush()
        if count:
            yield flush()

    texts = docs.select("doc_id", "text").where("text is not null and trim(text) != ''")
    raw = texts.mapInArrow(detect, "doc_id bigint, level int, said string, term string, n bigint, m bigint")
    told = F.col("said") != ""
    seen = write_table(raw.where((F.col("level") > 0) | told | F.col("term").isNotNull()).withColumns({"key": F.when(told, F.xxhash64("said")), "said": F.when(F.col("level") > 0, F.col("said"))}), "residue")
    hosts_of = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.coalesce("question_id", "doc_id").alias("question"))
    rows = seen.where("key is not null").select("doc_id", "level", "key", "said").join(hosts_of, "doc_id")
    same = rows.groupBy("key").agg(F.count("*").alias("n_copies"), F.count_distinct("host").alias("n_hosts"), F.max("level").alias("most"), F.min("doc_id").alias("first"))
    same = write_table(same.where((F.col("most") > 0) | (F.col("n_copies") >= copies) & (F.col("n_hosts") >= hosts)), "same")

    # Wording that no pattern knows: texts on several hosts, of terms that are typical of this corpus's messages.
    count = seen.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where((F.col("m") >= TERM_RECORDS) & (F.col("m") >= TERM_SHARE * F.col("n")))
    typical = frozenset(r.term for r in count.orderBy(F.desc("m"), "term").limit(TERMS).collect())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [judge(t)[1] for t in b.column(1).to_pylist()]
            ok = [len(k := terms(x)) > 0 and len(k & typical) >= max(2, 0.5 * len(k)) for x in said]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said)], ["key", "said"]).filter(pa.array(ok))

    unknown = same.where("most = 0").select("key", F.col("first").alias("doc_id")).join(docs.select("doc_id", "text"), "doc_id").select("key", "text")
    learned = unknown.mapInArrow(compare, "key bigint, said string")
    by_words = rows.where("level = 0").drop("said").join(learned, "key").select("doc_id", F.lit(1).alias("level"), "key", "said", "host", "question")
    suspect = rows.where("level > 0").unionByName(by_words).join(same.select("key", "n_copies", "n_hosts"), "key")

    about = F.concat_ws(" ", "title", "tags") if "tags" in docs.columns else F.col("title")
    titles = docs.where("title is not null").select(F.col("doc_id").alias("question"), F.lower(about).alias("_title"))
    words = lambda c: F.filter(F.split(F.regexp_replace(c, r"[^\p{L}]+", " "), " "), lambda w: F.length(w) > 3)
    joined = suspect.join(titles, "question", "left")
    shared, of = F.size(F.array_intersect(words(F.col("said")), words(F.col("_title")))), F.size(F.array_distinct(words(F.col("_title"))))
    chance = F.when((F.col("level") == 2) | (F.length("said") > SHORT_CHARS), of / 2).otherwise(F.lit(0.0))  # a page has words that any title may have
    apart = F.col("_title").isNull() | (shared <= chance)
    wording = F.when(F.col("level") == 2, READS).otherwise(HINTS)
    many = (F.col("n_copies") >= copies) & (F.col("n_hosts") >= hosts)
    score = wording + F.when(many, 1).otherwise(0) + F.when(F.col("n_hosts") >= hosts, 1).otherwise(0) + apart.cast("int")
    messages = joined.select("doc_id", F.lit("message").alias("kind"), wording.alias("wording"), "n_copies", "n_hosts", apart.alias("apart"), score.alias("score"))
    alone = seen.where("level = 2 and key is null").select("doc_id", F.lit("placeholder").alias("kind"), F.lit(READS).alias("wording"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(1).cast("bigint").alias("n_hosts"), F.lit(True).alias("apart"), F.lit(NEEDED).alias("score"))
    return alone.unionByName(messages)


def residue(docs: DataFrame, copies: int = COPIES, hosts: int = HOSTS) -> DataFrame:
    """(doc_id): records that are left-overs instead of posts: those whose combined evidence reaches NEEDED.

    docs: doc_id, question_id, title, text, source, tags (optional). Null, empty and blank texts are never residue."""
    return evidence(docs, copies, hosts).where(F.col("score") >= NEEDED).select("doc_id")
