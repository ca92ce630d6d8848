"""Wording from general knowledge that the residue models start from, by family, and prose about such things.

Nothing here was taken from the documents that are judged. A family is one kind of residue in one kind of wording, so that it can be left
out to see how far the others carry.
"""

from __future__ import annotations

import random
from itertools import product

# Phrases of HTTP status codes.
STATUS = "400 Bad Request|401 Unauthorized|403 Forbidden|404 Not Found|405 Method Not Allowed|408 Request Timeout|410 Gone|413 Payload Too Large|429 Too Many Requests|500 Internal Server Error|501 Not Implemented|502 Bad Gateway|503 Service Unavailable|504 Gateway Timeout".split("|")

#: Names that fields are given in the examples; shapes don't depend on them.
NAMES = "item userName name place ORDER_ID Company first_name city-name address MODEL unit.price".split()
_SYNTAX = "{{{%}}} {{{1}}} {{{%;}}} {{{%}}},{{{%}}} ${%} ${%.%} $%$ %^% $% $^ %(%)s #{%} <%=,%,%> <<%>> <<^>> <<^>>,of,<<^>> ##^## #%# @@%@@ __^__ *;^;* {%} {0} {^} {{,%,}} {{,%.%,}} {%,if,%,%} {%,endif,%} {%,for,%,in,%,%} {{subst:%}} {{subst:^}} {{subst:^}},({{subst:^}}) ~~~~ ~~~~~ [^] [%] [%,%] [%,of,%] [%],in,[%] [insert,%,here] ____ ________ __/__/____ ____-__-__ %:,________ #REF! #N/A #VALUE! @%@ ${^} <?=,$%,?>".split(" ")


#: What may stand around a field.
AROUND = "@|the @ of|of @.|of @ in|a @ in the|is a @ of|in @, and|Of @ and|. @ was|(@)| @ ).|on @ in @ and|, the @ at|name = @|= @\n|\n@\n|@ was first|it had @ people|the @, about|Of the @.|by @, 12|town of @. In|had @ in|a @,".replace("\\n", "\n").split("|")


def _filled(patterns: list[str], rng: random.Random) -> list[str]:
    """Patterns with names for % (as they are) and ^ (in capitals), in short surroundings."""
    out = []
    for p in patterns:
        p = p.replace(",", " ").replace(";", "|")  # as the list is written
        guarded = p.replace("{% ", "{\1 ").replace(" %}", " \1}").replace("<%=", "<\1=").replace("%>", "\1>").replace("%(%)s", "\1(%)s").replace("%^%", "\1^\1").replace("\\%{", "\1{")
        for around in AROUND:
            text = guarded
            while "%" in text or "^" in text:
                text = text.replace("%", rng.choice(NAMES), 1) if "%" in text else text.replace("^", rng.choice(NAMES).upper(), 1)
            out.append(around.replace("@", text.replace("\1", "%")))
    return out


def _all(*parts: str) -> list[str]:
    """Every sentence of the alternatives of each part."""
    return ["".join(x) for x in product(*(p.split("|") for p in parts))]


_VALUES = _all("is |of |in |by |was |nan |the |", "undefined|NaN|[object Object]|null|None|nan|NULL", "| it| in |. In|.|,|]]") + _all("TODO: |TODO |FIXME: |FIXME |XXX: |TBD: ", "add |check |write |fix |") * 6
_VALUES += _all("|is |of |", "XXXX|XX|XXX|0000|--|??|xxxx", " |.|,") * 2 + _all("xx.xx.xxxx|dd/mm/yyyy|YYYY-MM-DD|00/00/0000|INVALID DATE|#ERROR!|Infinity", "| |.|,")
#: Notes to insert something; their shape tells them.
_NOTES = "[Name einfügen]|[Datum einfügen]|[hier Text einfügen]|[bitte ergänzen]|[Anzahl]|[insérer le nom]|[nom à compléter]|[nombre]|[insertar nombre]|[completar]|[número]|[inserire nome]|[wstaw nazwę]|[insert name here]|[your name here]|[Company Name]|[to be added]|[Details of the item to be added]|[Please add a short description of the place]|[Text to follow later on]|[some words about the author will be provided]|[Notes on the work to be written]|[Summary for this chapter to be given]".split("|")
_NOTES_ABROAD = "[вставить имя]|[указать дату]|[число]|[ここに名前]|[名前を入れる]|[在此输入]".split("|")

# The traditional filler text.
_LATIN = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."


def _shuffled(rng: random.Random) -> list[str]:
    words = _LATIN.lower().replace(",", "").replace(".", "").split()
    return [_LATIN, *(" ".join(rng.choice(["lorem", "ipsum", "dolor", *words]) for _ in range(30)) for _ in range(12)), "Nulla facilisi. Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.", "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas."]


_FILLS = _all("Your |Some |Sample |Dummy |Placeholder |Body |More |Add your |Insert |Put your |Enter ", "text |content |copy |paragraph |description |title |heading ", "here|goes here|will go here|comes here", ".|") + _all("This is |Here is |", "a placeholder|dummy text|sample text|filler text|some text|a sample paragraph|test content", ".|, please replace it.|. Replace it with real content.|, to be replaced later.")
_FILLS += _all("Write |Add |Tell us |Say |Share ", "something |a few words |more |a short text |a line or two ", "about ", "yourself|your company|your work|what you do|the author|the event", " here|", ".|!")
_FILLS += "Hier kommt Ihr Text hin.|Hier steht ein Beispieltext.|Das ist ein Blindtext.|Platzhaltertext, bitte ersetzen.|Votre texte ici.|Ceci est un texte de remplissage.|Texte provisoire à remplacer.|Su texto aquí.|Este es un texto de ejemplo.|Texto de relleno, por favor reemplazar.|Il tuo testo qui.|Testo segnaposto da sostituire.|Seu texto aqui.|Tekst zastępczy, proszę wstawić treść.|Здесь будет ваш текст.|Это пример текста, замените его.|ここに本文が入ります。|これは仮のテキストです。|在此处输入文字。".split("|")
_MASHED = "asdf asdf asdf|asdf jkl qwerty|qwerty qwerty uiop|foo bar baz foo bar|foo foo bar bar baz qux|bla bla bla bla|blah blah blah blah|test test test test|xxx xxx xxx xxx|abc abc abc abc|aaa bbb ccc ddd|blah bla foo bar asdf blah|hjkl hjkl asdf".split("|")

_HTTP = [*STATUS, *(f"HTTP {x}" for x in STATUS), *(f"Error {x.split(' ', 1)[0]}: {x.split(' ', 1)[1].lower()}" for x in STATUS), *(f"HTTP Error {x}" for x in STATUS), *(f"({x.split(' ', 1)[1]})" for x in STATUS), *_all("Error |Status |Code ", "404|500|502|503|403", ". | - |: ", "Please try again later.|The server could not complete the request.|An error occurred.|Contact the administrator.")]
_GONE = _all("The page |The document |The resource |The article |This page ", "you requested |you are looking for |", "could not be found|was not found|does not exist|cannot be displayed|is not available|may have been moved or deleted|has been removed", ".|. Please check the address.|. Try the search or go to the home page.") + _all("Sorry, |Oops! |We're sorry, |", "page not found|nothing was found here|this page could not be loaded|something went wrong|an unexpected error has occurred", ".|. Please try again later.|. Please try again in a few minutes.")
_GONE += _all("We cannot find |We couldn't find |Unable to find |Nobody could find ", "the page you want|this page|the article|your page", ".|. It may have moved.|. It might be gone for good.|. Check the spelling.")
_SERVER = _all("The server |Our server |The site |This service ", "is temporarily unavailable|is having technical difficulties|is down for maintenance|encountered an internal error|took too long to respond|returned an error|is overloaded", ".|, please try again later.|. We are working on it.|. Request ID: 5e1f09.|. Retry in 30 seconds.") + _all("Access denied. |Permission denied. |Login required. |Session expired. |Forbidden. ", "You do not have permission to view this page.|Please log in to continue.|Please sign in again.|Your session has timed out.|Contact your administrator.")
_DATABASE = "Error establishing a database connection.|Database error: the query failed.|Database query timed out.|A database query error has occurred. No rows returned.|MySQL error 1045: Access denied for user|SQLSTATE[HY000] [2002] Connection refused|The query was aborted because it took too long.|Could not connect to the database server.|ERROR: relation does not exist|Deadlock found when trying to get lock".split("|")
_TRACES = "Traceback (most recent call last):\n  File \"app.py\", line 12, in <module>\nValueError: invalid literal|Exception in thread \"main\" java.lang.NullPointerException\n\tat com.example.Main.run(Main.java:42)|Fatal error: Uncaught Error: Call to undefined function in /var/www/html/index.php:31|Fatal error: Uncaught exception in /srv/app/view.inc:7|Stack trace:\n#0 {main}\n  thrown in /var/www/html/lib.php on line 8|Parse error: syntax error, unexpected end of file in /home/site/page.php on line 3|Warning: include(): failed to open stream: No such file or directory|Notice: Undefined variable: title in /srv/page.php on line 14|TypeError: Cannot read properties of undefined|Segmentation fault (core dumped)|panic: runtime error: index out of range|Unhandled rejection Error: timeout of 3000ms exceeded|KeyError: 'name'|at Object.<anonymous> (/srv/app/index.js:10:5)".split("|")
_WIKI = "Script error: No such module.|Lua error in Module:Example at line 12: attempt to call a nil value.|Lua error: too many expensive function calls.|Template loop detected: Template:Example|Expression error: Unexpected < operator.|Error: Invalid time.|Failed to parse (syntax error): \\frac|Cite error: The named reference was invoked but never defined.|Error creating thumbnail: File missing|Expansion depth limit exceeded.|The page could not be rendered.|Node count limit exceeded|Rendering of this page failed.".split("|")
_OTHERS = "Die gesuchte Seite wurde nicht gefunden.|Diese Seite existiert nicht.|Seite nicht gefunden.|Ein interner Fehler ist aufgetreten.|Der Server ist vorübergehend nicht erreichbar.|La page demandée est introuvable.|Page non trouvée.|Cette page n'existe pas.|Une erreur interne est survenue.|Página no encontrada.|La página solicitada no existe.|Se ha producido un error interno.|Pagina non trovata.|La pagina richiesta non esiste.|Si è verificato un errore interno.|Página não encontrada.|Pagina niet gevonden.|Nie znaleziono strony.|Wystąpił błąd wewnętrzny serwera.|Страница не найдена.|Запрошенная страница не существует.|Внутренняя ошибка сервера.|ページが見つかりませんでした。|お探しのページは存在しません。|找不到页面。|服务器内部错误。".split("|")
_SCRIPTS = _all("Please |You must |You need to |", "enable |turn on |activate |allow |switch on ", "JavaScript|scripts|scripting|JavaScript and cookies", " to continue.| to view this page.| in your browser.| in your browser settings and reload the page.| to use this site.| to run this application.| to read this article.") + _all("JavaScript |Scripting ", "is disabled|is turned off|is not enabled|appears to be off|is blocked", " in your browser.|. Please enable it.|. Some features of this site will not work.|. Parts of this page will not load.")
_SCRIPTS += _all("This page |This site |This application |This website ", "requires |needs |works only with |does not work without ", "JavaScript.|JavaScript to be enabled.|scripts.|a browser that runs scripts.") + _all("Your browser ", "does not support JavaScript|has JavaScript disabled|is blocking scripts|does not run scripts", ".|; the content cannot be displayed.|. Please update or change your settings.") + ["<noscript>Please enable JavaScript.</noscript>", "<noscript>Your browser does not support JavaScript!</noscript>", "Loading... please enable scripts if nothing appears."]
_COOKIES = _all("Please |You must |", "enable |accept |allow ", "cookies|cookies in your browser|cookies and scripts|cookies and JavaScript", " to continue.| to use this site.| and reload the page.| to log in.") + _all("This site |This page ", "requires cookies|needs cookies to work|uses cookies; please accept them", ".| to continue.")
_ROBOTS = _all("Checking |Verifying |Please wait while we check |We are checking ", "your browser|that you are human|your connection|that you are not a robot|if the site connection is secure", " before you proceed.| before accessing the site.|...|. This may take a few seconds.") + "Please complete the security check to access the site.|Please verify that you are a human.|Confirm that you are not a robot.|Complete the captcha to continue.|DDoS protection is active. You will be redirected shortly.".split("|")
_FOREIGN = "Bitte aktivieren Sie JavaScript in Ihrem Browser.|Für diese Seite wird JavaScript benötigt.|Bitte Cookies zulassen, um fortzufahren.|Veuillez activer JavaScript dans votre navigateur.|Ce site nécessite JavaScript.|Veuillez accepter les cookies pour continuer.|Por favor, active JavaScript en su navegador.|Este sitio requiere JavaScript.|Habilite las cookies para continuar.|Abilita JavaScript nel browser per continuare.|Questo sito richiede JavaScript.|Ative o JavaScript para continuar.|Włącz obsługę JavaScript w przeglądarce.|Ta strona wymaga włączonej obsługi skryptów.|Schakel JavaScript in om verder te gaan.|Пожалуйста, включите JavaScript в браузере.|Для работы сайта требуется JavaScript.|JavaScriptを有効にしてください。|この機能を使うにはJavaScriptが必要です。|请启用JavaScript以继续。".split("|")


def families() -> dict[str, tuple[str, list[str]]]:
    """Kind and examples of each family."""
    rng = random.Random(1)
    return {
        "syntax": ("field", _filled(_SYNTAX, rng)), "notes": ("field", [a.replace("@", t) for t in _NOTES for a in AROUND] + _NOTES_ABROAD), "values": ("value", _VALUES), "latin": ("filler", _shuffled(rng)), "fills": ("filler", _FILLS), "mashed": ("filler", _MASHED * 3), "status": ("notice", _HTTP), "gone": ("notice", _GONE), "server": ("notice", _SERVER),
        "database": ("notice", _DATABASE * 3), "traces": ("notice", _TRACES * 3), "wiki": ("notice", _WIKI * 3), "errors abroad": ("notice", _OTHERS * 3), "scripts": ("notice", _SCRIPTS), "cookies": ("notice", _COOKIES), "robots": ("notice", _ROBOTS), "scripts abroad": ("notice", _FOREIGN * 3),
    }


#: Prose about such things; it must not count.
MENTIONS = [
    "In web protocols the status code 404 tells a client that the page was not found, and 500 stands for an internal error.", "A server answers with the code 503 when it is unavailable; most browsers then show a page of their own.", "JavaScript is a programming language; nearly every browser runs it, and readers may turn it off.", "Early sites worked without JavaScript, and many users disabled scripts and cookies altogether.",
    "Cookies are small pieces of data that a browser stores for a site; laws require that visitors accept them.", "A placeholder is a sign that stands for something else, for instance a variable in a formula or a name in a form.", "Printers have used nonsense Latin as dummy text since the sixteenth century to show a typeface.", "The term filler text means words that fill a page before the content is written.",
    "The template takes a name and a date and shows them in a box.", "An error message tells the user that something went wrong.", "The stack trace names the functions that were called.", "She kept a list of things to do and crossed out what was done.", "The value is undefined at zero, since division by zero has no result.", "None of the villages had more than 500 inhabitants.",
    "Estimates differ by 12 % [3]; compare [note 1] and [b].", "Database systems abort queries that take too long.", "A captcha asks visitors to prove that they are human.", "The session of the parliament expired in May.", "Access to the harbour was denied to foreign ships.", "The service was unavailable in winter, when the pass was closed.",
    "The population grew until the number of people fell again in the next century.", "He was born in the name of the saint, and the date of the feast is kept in the region.", "Die Seite behandelt die Geschichte des Ortes.", "La page traite de l'histoire du village.", "La página trata de la historia de la aldea.", "{{citation needed|date=June 2009}} {{convert|12|km|mi}} {{main|History}} [[Category:Villages]]", "{{Infobox settlement\n| name = \n| population = \n| area = 12\n| mayor = \n}}",
]
