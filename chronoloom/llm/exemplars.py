"""Labelled exemplars of template residue, written from what is publicly known.

The messages are those of HTTP status codes, common web servers and frameworks, browsers' and portals' error pages, log in
and maintenance notices, script notices and layout filler, in six languages. They are written in the tokens of
:mod:`chronoloom.llm.residue` and by rule: ``(a|b|)`` stands for any one of its alternatives. Classes: ``<slot>`` an
unfilled placeholder, ``<gap>`` a doubtful one, ``<n>`` a number, ``<id>`` a hexadecimal code, ``<path>`` a file or
address, ``<filler>`` a word of filler text, ``<rep>`` a word that was one of the two before, ``<doc>`` a word for a page, file or
site, ``<script>`` one for scripts, and ``<any>`` a word that differs from text to text, which weighs nothing.
"""

from __future__ import annotations

import re

#: The two common filler passages, and words typed to fill a space.
FILLER_TEXT = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum "
    "sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto "
    "beatae vitae dicta sunt explicabo nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt"
)
TYPED_FILLER = "lipsum asdf asdfgh qwer qwerty foobar xxx xxxx xxxxx tbd tba todo".split()

#: Short words of the passages, and these, are also words of living languages.
LIVING_WORDS = frozenset("error culpa dicta dolores magna quasi omnis ratione".split())
FILLER_WORDS = frozenset([w for w in FILLER_TEXT.split() if (len(w) > 4 or w in ("amet", "elit")) and w not in LIVING_WORDS] + TYPED_FILLER)

#: Words for scripts in a browser, and for what a browser opens.
SCRIPT_WORDS = frozenset("javascript js script scripts scripting skript skripte skripten javascriptin javascriptiä скрипт скрипти скриптів".split())
DOC_WORDS = frozenset(
    "page pages webpage file document resource url link address article site website app application seite webseite website datei dokument adresse anwendung "
    "fichier página sitio archivo documento dirección aplicación sivu sivua sivusto sivustoa tiedosto tiedostoa сторінка сторінку сайт файл файлу документ".split()
)

#: Names of fields in forms and letters, of which placeholders are made.
FIELD_WORDS = frozenset(
    "name first last full user username company organization title product item order id number no date time day month year amount price total count quantity city country state "
    "street address zip code email mail phone link url website page author subject message recipient customer client invoice site description text content image logo here your the a insert".split()
)

_MISSING = "(not found|was not found|could not be found|cannot be found|does not exist|doesn t exist|no longer exists|is not available|is no longer available|is unavailable|is missing|is gone|has moved|has been moved|has been removed|has been deleted|is not here|is no longer here)"
_SOUGHT = "(you requested|you asked for|you are looking for|you re looking for|you were looking for|you wanted|you tried to open)"

#: Passages that are residue, by kind.
RESIDUE = {
    "placeholder": """
<slot>
<gap> <any> <gap>
<gap> <any> <any> <gap>
<gap> <any> <any> <any> <gap>
""",
    "filler": """
<filler> <filler> <filler>
<filler> <any> <filler> <filler>
<filler> <filler> <any> <any> <filler>
<filler> <any> <filler> <any> <any> <filler>
<rep> <rep> <rep>
<rep> <rep> <rep> <rep> <rep> <rep> <rep> <rep>
(your|the) (text|title|content|headline|name|caption|description|image|heading) (here|goes here)
(insert|add|enter|type|write|put) (your|a|the) (short|) (text|title|content|description|caption|headline|copy|body) (of the article|) here
(insert|add|enter|type|write) (text|content|copy|title|description) (here|for this section)
(click|double click|tap) (here|) to (edit|add|change) (this|your|) (text|title|content)
this is (a|some|) (placeholder|sample|dummy|example) (text|paragraph|page|)
(sample|placeholder|dummy|example|filler) (text|paragraph|title|caption|headline|heading|content|image)
(headline|title|subtitle|text|image|caption|heading) (placeholder|to follow|to come)
(text|paragraph|image|content) for (layout|demonstration|display) (only|purposes only)
(replace|change|remove) (this|me|it|with your own text) before (publishing|going live|launch)
(todo|fixme) : (write|add|fill in|replace) (this|)
(todo|fixme) : (description|title|text|content|summary)
(insert|add|enter|write) (caption|title|text|description|image|date|name)
(todo|fixme) (write|add|fill in|replace) (copy|text|content) (for|)
to be (added|announced|determined|written|completed)
(title|details|text|description) to (follow|come)
just another (blog|<doc>)
welcome to your new <doc> . this is your first post . edit or delete it , then start writing
""",
    "missing": f"""
<n> (bad request|unauthorized|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout)
(http|status|error|http error|error code|server error) <n>
(http|status|error|http error|error code) <n> ( (bad request|unauthorized|forbidden|not found|internal server error|bad gateway|service unavailable) )
(<n>|error|http <n>) (–|:|-) <doc> (not found|not available|missing|gone|not here)
not found
<doc> {_MISSING}
(resource|item|entry|object|content) (not found|not available|unavailable)
the <doc> {_SOUGHT} {_MISSING}
the requested <doc> {_MISSING}
the requested <doc> <path> {_MISSING}
the requested <doc> was not found on this server
the <doc> <path> (was not found|could not be found|does not exist|cannot be opened|cannot be served|is not available)
(we|we re sorry , we|sorry , we) (could not|couldn t|cannot|can t) find (the|that|this) <doc>
(that|this) <doc> (can t|cannot|could not|couldn t) be found
nothing (was|) (found|here|matches your search|matched your search)
(no|zero) (results|hits|matches|entries|items) (found|for <any>|for <path>|for your search)
(nothing|no match|<n> results|<n> hits) (found|) for <path>
your search (did not match any documents|returned no results)
sorry , this (content|<doc>|video|item) isn t available (right now|anymore)
(this|the) (video|content|item|article|post|product|listing|account|profile) is (unavailable|not available|no longer available)
this (account|profile|post|video|listing|item) has been (suspended|deleted|removed|disabled)
there isn t a (<doc>|github pages <doc>) here
the specified (key|bucket|item|<doc>) does not exist
the origin server did not find a current representation for the target resource
(matching query|no matching record) does not exist
(record|object|entity|user|post|entry) not found
it looks like nothing was found (here|at this location)
no (posts|products|pages|comments|articles) (found|to show|to display|matched your search)
(go|return|go back|back) to the (home|start|front|previous) page
(go|return) to the (home|start) page or (use|try) the search (box|)
""",
    "refused": """
(access|permission) (denied|forbidden|refused)
(forbidden|unauthorized|not authorized|not allowed|authentication required|login required|authorization required)
(error|http) <n> (forbidden|unauthorized)
you (do not|don t) have (permission|access|the right|any right|authorization) to (access|view|see|open) (this <doc>|<path>)
you have no (permission|access|right) to (view|see|open) (this <doc>|<path>)
you are not (authorized|allowed|permitted) to (access|view|see|open) (this <doc>|<path>)
you (may|can|must) not (access|view|see|open) (this <doc>|<path>)
you need (permission|another role|a different role|to log in|to sign in) (to see|to open|for) (this <doc>|<path>)
(please|you must|you need to) (log in|sign in|login) (again|once more|) to (continue|go on|view this <doc>|see this <doc>)
please (start over|sign in|log in) (again|once more)
(your|the|this) (session|login|token|link) (has|) (expired|ended|timed out|run out)
your (session|login|token) (is no longer valid|is invalid)
access to this <doc> has been (denied|blocked|restricted)
your (ip|ip address|account|request) has been (blocked|banned|suspended|denied)
(please|) enable cookies (to continue|and reload|in your browser|)
""",
    "failure": """
(bad gateway|gateway timeout|gateway time - out|service unavailable|service temporarily unavailable|internal server error|too many requests|request timed out|connection refused|connection timed out|connection reset|upstream failure|upstream error|upstream timed out)
(the|this) (service|server|<doc>) (is|) (temporarily|currently) (unavailable|down|offline|overloaded)
(the|our) (server|service|backend|upstream|origin|host) <any> (is down|is unavailable|is not ready|is not responding|did not respond|timed out|gave no reply|sent no reply|sent no valid answer|closed the connection|returned an invalid response)
(the|our) (server|service|backend|<doc>) behind <any> (is down|is unavailable|is not ready|is not responding)
(origin|host|upstream) <any> (did not respond|timed out|gave no reply|gave no answer|sent no valid answer|closed the connection|refused the connection)
(<any>|) (gave no|sent no) (valid|) (reply|answer|response) ( <n> )
(something|oops , something|sorry , something) went wrong (here|on our side|on our end|)
(an|oops , an|sorry , an) (unexpected|) error (occurred|has occurred|came up|happened) (here|on our side|on our end|)
(that|this|it) (did not|didn t) work (here|on our side|)
(oops|whoops|uh oh|uh - oh) , (that|this|it) (did not|didn t) work
(please|) (try again|retry|reload|come back|check back) (later|soon|in a few minutes|in <n> minutes|in <n> seconds|in <n> hours)
(please|) (slow down|wait) and (reload|retry|try again) in <n> (minutes|seconds)
(come back|check back|try again) after <n>
(your|the) connection (was reset|was refused|was interrupted|timed out|is not private|is not secure)
this <doc> can t be reached
the server encountered an (internal|unexpected) (error|condition)
(rate limit|quota|request limit) (exceeded|reached|used up)
(failed|unable) to (load|fetch|open|read) <any>
could not (load|fetch|open|read) <any>
<any> <id> could not be (loaded|read|fetched|opened)
(tap|click|press) to (retry|try again|reload)
(retry|reload) (close|cancel|dismiss)
(close|cancel|dismiss) (retry|reload)
(error|trace|request|reference|ray|ticket|incident|support) id (:|) <id>
(reference|id|code|trace|ray|ticket|incident) (:|) <id>
<doc> (is|) (down|offline|closed) for (maintenance|an upgrade|an update|repairs)
(we are|we re|we ll be) (down|offline|closed|away) for (scheduled|planned|routine|an|) (maintenance|work|upkeep|upgrade|update)
(under|scheduled|planned) (construction|maintenance)
(this|the|our) <doc> is (under|currently under) (construction|maintenance)
(we ll|we will) be (right back|back soon|back shortly)
(back|coming|launching|opening) soon
thank you for (your patience|waiting)
thanks for (your patience|waiting)
traceback ( most recent call last ) : (file <path> , line <n> , in <any>|)
(fatal error|parse error|warning|notice|deprecated) : <any> in <path> on line <n>
(fatal error|uncaught error) : call to (a member function|undefined function|undefined method) <any> ( ) (on null|) in <path>
(notice|warning) : undefined (variable|index|offset|array key) <any> in <path> on line <n>
(missing|cannot open|failed to open) file <any> in <path> on line <n>
(uncaught|unhandled) (exception|error|typeerror|referenceerror)
(could not|cannot|can t|unable to) (connect|talk) to the (database|server) (on line <n> of <path>|at line <n> of <path>|)
(lost|no) connection to the (database|server) (on line <n> of <path>|at line <n> of <path>|)
error establishing a database connection
segmentation fault
server error in <any> <doc>
server error in <path> <doc>
(runtime|application|system|unexpected|fatal|database|syntax) error
(class|function|method) <any> not found in <path>
cannot modify header information - headers already sent
(table|view|table or view|column|database|relation) does not exist
(can t|cannot) connect to (local|) mysql server
java lang (nullpointerexception|illegalargumentexception|outofmemoryerror|classnotfoundexception)
you are being redirected
if you are not redirected automatically , (click here|follow this <doc>|click the <doc>)
our systems have detected unusual traffic from your (computer|) network
(please|) complete the (captcha|recaptcha|challenge|security check) (to proceed|to continue|)
attention required
your browser is (out of date|outdated|not supported|no longer supported)
(please|) (update|upgrade) your browser
your browser does not support (frames|iframes|cookies|the video tag|html5 video|them)
this <doc> requires (frames|cookies|a newer browser)
(status|code) = <n> (error|message) = <any>
(request|trace) _ id = <id>
request_id = <id>
index of <path>
index of <path> name last modified size (description|parent directory)
directory listing for <path>
this (domain|address|name|domain name) (is for sale|is parked|may be for sale|has expired|is not configured|is not set up|is not set up yet)
(domain|name|address) (not configured|not claimed|for sale|parked)
(contact|write to|ask|email) the owner of <any> for (a price|an offer|a quote)
(checking|verifying) your browser before (accessing|showing|opening|loading) <any>
checking if the <doc> connection is secure
(please wait|just a moment) while we (check|verify) (that you are human|your browser|your request)
(prove|verify|confirm|show) (that|) you are (human|not a robot|a human)
(tick|check) the box (and|to) (continue|press continue|click continue)
type the letters (and|to) (continue|press continue|click continue)
complete the (captcha|security check) to (continue|access <any>)
""",
    "scripts": """
(please|kindly|) (enable|activate|allow|turn on|switch on|unblock) <script>
(please|) (turn|switch) <script> on
to (use|view|see|access) <any> , please (enable|turn on|activate) <script>
to (use|view|see) <any> <any> , please (enable|turn on|activate) <script>
this <doc> uses <script>
(activate|enable) it to (see|view|use) (all|the|this) (content|<doc>)
(please|kindly|) (enable|activate|allow|turn on|switch on) <script> (in your browser|to continue|and reload|to use this <doc>|to view this <doc>)
(you need to|you have to|you must|to continue ,|to go on ,) (enable|activate|allow|accept|turn on|switch on) <script>
you (need to|have to|must) (enable|allow|accept) <script> and cookies (before you can|to) (continue|enter|go on|read|view)
you need to enable <script> to run this <doc>
we re sorry but <any> doesn t work properly without <script> enabled . please enable it to continue
(this|the) <doc> (requires|needs|relies on|depends on) <script>
(this|the) <doc> (requires|needs|relies on|depends on) <script> to (work|function|run|load)
(this|the) <doc> (does not work|doesn t work|cannot run|cannot work|will not work|works best) (without|with) <script>
<script> (is|are|is currently|seems to be) (disabled|required|blocked|turned off|switched off|off|not enabled|not supported|missing)
<script> support is (disabled|required|blocked|turned off|switched off|off|missing)
<script> (must be|has to be|have to be|should be) (enabled|active|turned on|on|running)
your browser (does not support|doesn t support|does not run|has disabled|blocks|is blocking) <script>
noscript your browser (does not support|does not run|has disabled|blocks) <script>
your browser has (<script> disabled|<script> blocked|<script> blocking on|no <script>|no active <script>)
(it looks like|it seems|looks like|seems|we noticed|we detected) (that|) your browser has (<script> disabled|<script> blocked|<script> blocking on|no active <script>)
(it looks like|it seems|we noticed|we detected) that <script> is disabled (in your browser|)
(turn|switch) (it|them) on in your browser (settings|)
(check|change) (it|this|) (in|) your browser settings (and reload|)
(parts|some parts|some features) of (this <doc>|<any>) will not (work|load|be shown|be loaded)
<any> (cannot|can t|will not) (start|load|be shown) without <script>
""",
    "german": """
(die|das) <doc> (wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht|existiert nicht mehr|gibt es nicht|gibt es nicht mehr|ist nicht verfügbar|wurde verschoben|ist umgezogen|wurde gelöscht|fehlt)
(die|das) <doc> <path> (wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht|gibt es nicht|ist nicht verfügbar|wurde verschoben|ist umgezogen|fehlt)
(die|das) (angeforderte|gewünschte|gesuchte) <doc> (wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht|ist nicht verfügbar)
<doc> nicht (gefunden|verfügbar|erreichbar)
(keine|<n>) (ergebnisse|treffer) (gefunden|für <any>)
(zugriff|zugang) (verweigert|gesperrt|nicht erlaubt|verboten)
sie (dürfen|können) <path> nicht (öffnen|sehen|aufrufen)
sie (haben keine berechtigung|sind nicht berechtigt) , (diese <doc>|<path>) (anzuzeigen|zu öffnen|aufzurufen)
der (server|dienst) ist (zurzeit|derzeit|gerade|momentan|vorübergehend) nicht (erreichbar|verfügbar|bereit)
(interner serverfehler|fehler <n>)
(fehlernummer|fehlercode|kennung|referenz) <id>
(ihre|die) (sitzung|anmeldung) ist abgelaufen
bitte (melden sie sich (erneut|wieder) an|neu anmelden|erneut anmelden)
(hier|da|leider|es) ist (leider|) (was|etwas|ein fehler) (schiefgelaufen|schief gelaufen|aufgetreten)
(leider|ups ,|hoppla ,) (da|) ist (was|etwas) (schiefgelaufen|schief gelaufen)
bitte (versuchen sie es|) (später|in kürze) (noch einmal|erneut|wieder) (versuchen|)
(bitte|) (laden sie die <doc> neu|neu laden)
diese <doc> (braucht|benötigt|erfordert|funktioniert nur mit) (aktive|aktiviertes|) <script>
bitte (aktivieren|erlauben|schalten) sie <script>
bitte (aktivieren|erlauben) sie <script> (in ihrem browser|, um <any> zu (sehen|öffnen|nutzen))
bitte (schalten|stellen) sie <script> (ein|an) (|, um <any> zu (sehen|öffnen|nutzen))
sie (müssen|sollten) <script> aktivieren
<script> ist (deaktiviert|ausgeschaltet|blockiert|nicht aktiviert)
(wartungsarbeiten|wegen wartung geschlossen)
diese <doc> befindet sich im aufbau
(hier|) (steht ihr text|text einfügen|ihr text)
(beispieltext|blindtext|platzhaltertext)
""",
    "french": """
(la page|le <doc>|le document|la ressource|l <doc>|l adresse|cette page) (est introuvable|n existe pas|n existe plus|a été déplacée|a été déplacé|a été supprimée|a disparu|n est pas disponible)
(la page|le <doc>|le document|l adresse) <path> (est introuvable|n existe pas|n existe plus|a été déplacée|a été déplacé|a disparu)
(page|ressource|<doc>) (introuvable|non trouvée|non trouvé)
erreur <n>
aucun résultat (trouvé|pour <any>)
(accès|accès à <path>) (refusé|interdit)
accès (refusé|interdit) à <path>
vous n (avez pas l autorisation|êtes pas autorisé) (d accéder|à accéder|de voir) (cette page|<path>)
le (service|serveur) est (temporairement|actuellement|) (indisponible|surchargé)
le (service|serveur) est indisponible pour le moment
(une erreur|une erreur inattendue) (est survenue|s est produite|est apparue)
(veuillez|merci de) (réessayer|revenir) (plus tard|dans quelques minutes|)
(votre session|la session) a expiré
(veuillez|merci de) vous (reconnecter|identifier)
(ce site|cette page|cette application|ce <doc>) (nécessite|requiert|a besoin de) (des|) <script>
(ce site|cette page|cette application|ce <doc>) a besoin de <script> (actifs|) (dans votre navigateur|)
veuillez (activer|autoriser) (les|) <script>
veuillez (activer|autoriser) (les|) <script> pour (afficher|ouvrir|voir|continuer) <any>
(vous devez|il faut) activer <script>
<script> est désactivé
(site|page) en (construction|maintenance)
(votre texte ici|insérez votre texte ici|texte d exemple)
""",
    "spanish": """
(la|el) <doc> (no existe|no se encuentra|no se encontró|no se ha encontrado|ya no existe|se ha movido|no está disponible|ha sido eliminada)
(la|el) <doc> <path> (no existe|no se encuentra|no se encontró|ya no existe|se ha movido|no está disponible)
<doc> no (encontrada|encontrado|disponible)
error <n>
no se (encuentra|encontró|encontraron) (<path>|resultados)
acceso (denegado|prohibido|restringido) (a <path>|)
no tiene (permiso|autorización) para (ver|acceder a) (esta <doc>|<path>)
el (servidor|servicio) no está disponible (ahora|en este momento|temporalmente)
(se ha producido|ocurrió|ha ocurrido) un error (inesperado|)
algo (ha salido|salió|ha ido) mal
algo (ha fallado|falló)
(inténtelo|vuelva a intentarlo|inténtalo) (de nuevo|más tarde)
(vuelva|regrese) más tarde
(su|la) sesión ha (caducado|expirado|terminado)
(inicie sesión|identifíquese) (de nuevo|otra vez|para continuar)
(este sitio|esta página|este <doc>|esta <doc>) (necesita|requiere) <script>
(active|habilite|permita|activa) (los|) <script>
(active|habilite|permita) (los|) <script> para (ver|abrir|continuar) <any>
(este sitio|esta página|este <doc>|esta <doc>) necesita <script> (activos|) en su navegador
(necesita|debe|tiene que) (activar|habilitar) <script> (para (ver|usar|continuar)|)
<script> está (desactivado|deshabilitado)
(código|referencia) <id>
(página|sitio|<doc>) en (construcción|mantenimiento)
(su texto aquí|escriba su texto aquí|texto de ejemplo)
""",
    "ukrainian": """
<doc> (не знайдено|не існує|недоступна|недоступний|видалено|не відкрито)
<doc> <path> (не знайдено|не існує|недоступна|недоступний|видалено|не відкрито)
доступ (заборонено|закрито|обмежено)
доступ до <path> (заборонено|закрито|обмежено)
(сталася|виникла) (помилка|неочікувана помилка)
щось пішло не так
(спробуйте|повторіть) (пізніше|ще раз|знову)
(сервер|сервіс) (тимчасово|зараз) недоступний
(ваша сесія|сесія|сеанс) (закінчилася|завершено|завершилася)
(увійдіть|авторизуйтеся) (знову|ще раз)
(увімкніть|дозвольте|активуйте) <script>
(увімкніть|дозвольте) <script> , щоб (побачити|відкрити|переглянути|продовжити) <any>
(код|помилка) <id>
(сайт|<doc>) (на реконструкції|в розробці)
""",
    "finnish": """
<doc> (ei löytynyt|ei löydy|ei ole olemassa|on poistettu|on siirretty)
<doc> <path> (ei löytynyt|ei löydy|ei ole olemassa|on poistettu)
(pääsy|käyttö) (estetty|kielletty)
(jokin|jotain) meni (pieleen|vikaan)
tapahtui (odottamaton|) virhe
(istuntosi|istunto) on (vanhentunut|päättynyt)
kirjaudu (sisään|) uudelleen
yritä (myöhemmin|hetken kuluttua) uudelleen
(palvelu|palvelin) ei ole (juuri nyt|tällä hetkellä) (käytettävissä|saatavilla)
tämä <doc> (vaatii|tarvitsee) <script>
(ota <script> käyttöön|salli <script>) (selaimessasi|)
""",
}


def alternatives(pattern: str) -> list[str]:
    """Every passage a pattern stands for; the alternatives of an inner pair of parentheses come first."""
    inner = re.search(r"\(([^()]*\|[^()]*)\)", pattern)
    if not inner:
        return [" ".join(pattern.split())]
    found = []
    for choice in inner[1].split("|"):
        found += alternatives(pattern[: inner.start()] + choice + pattern[inner.end() :])
    return found


def labelled(kinds: tuple[str, ...] | None = None, without: tuple[str, ...] = ()) -> list[str]:
    """The exemplars, of some kinds only if wanted; each once."""
    chosen = [k for k in (RESIDUE if kinds is None else kinds) if k not in without]
    lines = [line for kind in chosen for line in RESIDUE[kind].strip().splitlines()]
    return list(dict.fromkeys(passage for line in lines for passage in alternatives(line) if passage))
