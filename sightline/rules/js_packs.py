"""Rule packs for JavaScript bodies: fixed values, notes in our own wording."""

from __future__ import annotations

from sightline.rules.packs import Rule

LINK_RULES = [
    ("Quoted absolute/relative path", r"""['"](/[a-zA-Z0-9_?&=/\-#.:%]{2,}?)['"]"""),
    ("Quoted full URL", r"""['"](https?://[a-zA-Z0-9_?&=/\-#.:%]{4,}?)['"]"""),
    ("API-ish path", r"""['"]((?:/|\.\./|\./)?(?:api|rest|graphql|v[0-9]+|internal|admin|ajax)[a-zA-Z0-9_?&=/\-#.:%]{1,}?)['"]"""),
    ("Endpoint with extension", r"""['"]([a-zA-Z0-9_\-/.]{2,}?\.(?:php|asp|aspx|jsp|json|action|do|xml))(?:\?[^'"]*)?['"]"""),
]
MIME_LIKE = r"(?i)^[a-z]+/[a-z0-9.+-]+$"

ROUTE_PREFIX = "Sensitive route in JS: "
ROUTES = [
    Rule("Sensitive route in JS: admin", "MEDIUM", r"(?i)(?:^|/)(?:admin|administrator|adm|backoffice|back-office|manager|management|console|sysadmin|superadmin|staff|operator)(?:/|$|\?|\.|-|_)", "confirm that the route is protected on the server"),
    Rule("Sensitive route in JS: actuator/diagnostic", "MEDIUM", r"(?i)(?:^|/)(?:actuator|heapdump|jolokia|env|metrics|trace|swagger-ui|swagger|api-docs|graphiql|phpinfo|server-status|_profiler|debug/vars|druid)(?:/|$|\?|\.)", "confirm that diagnostics are not public"),
    Rule("Sensitive route in JS: internal/debug", "LOW", r"(?i)(?:^|/)(?:internal|debug|_debug|__debug__|dev|staging|private|hidden|beta|test)(?:/|$|\?)", "confirm that the route is not reachable in production"),
    Rule("Sensitive route in JS: upload", "MEDIUM", r"(?i)(?:^|/)(?:upload|uploads|file-?upload|attach|attachments?|import)(?:/|$|\?|-|_)", "confirm that uploads are checked on the server"),
    Rule("Sensitive route in JS: export/download", "LOW", r"(?i)(?:^|/)(?:export|exports|backup|backups|dump|excel|csv)(?:/|$|\?|-|_|\.)", "confirm that exports are limited to the caller's data"),
    Rule("Sensitive route in JS: object by id", "MEDIUM", r"(?i)(?:^|/)(?:users?|members?|accounts?|customers?|orders?|profiles?|payments?|invoices?|documents?)/(?::[a-z_]{1,30}|\d{1,12})(?:/|$|\?)", "confirm that other users' objects are refused"),
    Rule("Sensitive route in JS: config/secrets", "LOW", r"(?i)(?:^|/)(?:config|configuration|\.env|secrets?|credentials?)(?:/|$|\?|\.json|\.ya?ml)", "confirm that configuration is not public"),
    Rule("Sensitive route in JS: GraphQL", "LOW", r"(?i)(?:^|/)graphql(?:/|$|\?)", "check whether introspection is on"),
]

HIDDEN_PARAM_PREFIX = "Hidden parameter in JS: "
PARAM_INTERESTING = r"(?i)^(?:debug|debug_?mode|test|testing|dev|devmode|admin|is_?admin|is_?staff|is_?super(?:user)?|role|roles|user_?role|group|groups|permission|permissions|perm|priv|privilege|internal|preview|draft|bypass|skip_?\w{1,20}|force|override|redirect\w{0,20}|return_?url|returnto|next|callback|jsonp|cb|url|uri|dest|destination|target|file|filepath|path|template|tpl|access_?level|tier|plan|price|amount|discount|coupon|user_?id|uid|account_?id|owner_?id|tenant_?id|org_?id|member_?id|verified|approved|show_?all|include_?deleted|deleted|hidden)$"
PARAM_RULES = [
    ("URL params accessor", r"""(?:[sS]earchParams|[pP]arams|[qQ]uery|URLSearchParams\([^()]{0,80}\))\.(?:get|getAll|has|append|set)\(\s*["'`]([A-Za-z_][\w.\-\[\]]{0,40})["'`]"""),
    ("FormData/params append", r"""\.append\(\s*["'`]([a-z_][\w\-\[\]]{0,40})["'`]\s*,"""),
    ("query string in literal", r"""["'`][^"'`\s<>();,]{0,150}?\?([A-Za-z_][\w\-\[\]]{0,40})="""),
    ("query string follow-on", r"(?<!&)&([A-Za-z_][\w\-\[\]]{0,40})=(?![=&])"),
    ("params object", r"""\b(?:params|data|query|searchParams)\s*:\s*\{\s*["']?([A-Za-z_$][\w$]{0,40})["']?\s*:"""),
]

CRYPTO = [
    Rule("CryptoJS cipher usage", "MEDIUM", r"CryptoJS\.(?:AES|DES|TripleDES|Rabbit|RC4|RC4Drop|RabbitLegacy|MD5|SHA1|SHA256|SHA512|HmacSHA256|HmacSHA1|PBKDF2|EvpKDF|enc|mode|pad|lib|format)\b", "encryption in the browser is no control: look for the key beside it"),
    Rule("Web Crypto API usage", "INFO", r"crypto\.subtle\.(?:encrypt|decrypt|sign|verify|digest|deriveKey|deriveBits|generateKey|importKey|exportKey|wrapKey|unwrapKey)\b", "trace where the key comes from"),
    Rule("forge crypto usage", "INFO", r"forge\.(?:cipher|pki|md|random|util|aes|rsa|rc2|des|hmac|pkcs5|pkcs7)\b", "look for a key beside it"),
    Rule("JSEncrypt client-side RSA", "MEDIUM", r"(?:new\s{1,5})?JSEncrypt\s{0,5}\(", "protects against passive reading only"),
    Rule("SJCL crypto usage", "INFO", r"sjcl\.(?:encrypt|decrypt|codec|hash|misc|cipher|bitArray)\b", "look for a passphrase beside it"),
    Rule("Weak cipher/hash algorithm", "LOW", r"""(?i)["'](?:MD5|MD4|SHA-?1|DES|DES-[A-Z0-9]{1,10}|RC4|3DES|AES-[0-9]{1,4}-ECB|[A-Z0-9-]{1,16}-ECB)["']""", "replace the algorithm"),
    Rule("Hardcoded crypto key/IV/salt", "MEDIUM", r"""(?i)(?:secretKey|secret_key|passphrase|\biv\b|\bsalt\b|encryptionKey|aesKey|privateKey)\s{0,8}[:=]\s{0,5}["'][A-Za-z0-9+/=_-]{8,64}["']""", "move the key out of the client", lead=True),
    Rule("Base64 encode/decode (atob/btoa)", "INFO", r"\b(?:atob|btoa)\s{0,5}\(", "encoding, not encryption"),
    Rule("Client-side JWT signing", "MEDIUM", r"(?i)(?:jwt|jose)\.sign\s{0,5}\(|KJUR\.jws\b|new\s{1,5}SignJWT\s{0,5}\(", "a signing secret must not be in the client"),
]
AUTHZ = [
    Rule("Client-side admin/role check", "MEDIUM", r"(?i)(?:is_?admin|is_?superuser|is_?staff|is_?owner|has_?role|has_?permission|has_?authority|can_?access|can_?edit|is_?authorized|checkPermission|checkRole|userHasRole)\s{0,5}\(", "confirm that the server checks it too"),
    Rule("Role equality comparison", "MEDIUM", r"""(?i)(?:\.role|\brole|userRole|user_?type|account_?type|\.scope)\s{0,5}[=!]==?\s{0,5}["'](?:admin|administrator|superuser|super_?admin|root|owner|manager|moderator|staff|operator|sysadmin)["']""", "confirm that the server checks it too"),
    Rule("Route/auth guard", "LOW", r"(?i)(?:requireAuth|requiresAuth|authGuard|roleGuard|canActivate|beforeEnter|requireRole|requireLogin|PrivateRoute|ProtectedRoute|RequireAuth|withAuth|ensureAuthenticated)\b", "confirm that the route's backend is protected"),
    Rule("Client-side permission list", "LOW", r"""(?i)["']?(?:permissions|roles|scopes|authorities|grants|privileges|capabilities|acl)["']?\s{0,5}[:=]\s{0,5}[\[{]""", "lists the permission vocabulary"),
    Rule("Admin UI gating flag", "LOW", r"(?i)(?:showAdmin|isAdminView|adminOnly|admin_?only|enableAdmin|admin_?enabled|canSeeAdmin|displayAdmin)\s{0,8}[:=]", "confirm that hidden pages are protected on the server"),
]
CONFIG = [
    Rule("Internal/non-prod host URL", "LOW", r"""(?i)https?://(?:localhost|127\.0\.0\.1|[a-z0-9.-]{1,60}\.(?:dev|test|qa|uat|stg|staging|internal|intranet|corp|local))(?:[:/][^"'\s]{0,80})?""", "remove non-production hosts from production code", lead=True),
    Rule("Hardcoded API base URL", "INFO", r"""(?i)(?:api_?base_?url|base_?url|api_?url|apiHost|endpoint|baseEndpoint|serviceUrl)\s{0,5}[:=]\s{0,5}["']https?://[^"']{1,120}["']""", "the API origin of the app", lead=True),
    Rule("Cloud storage bucket reference", "LOW", r"(?i)(?:[a-z0-9.-]{1,63}\.s3[.-][a-z0-9-]{1,30}\.amazonaws\.com|storage\.googleapis\.com/[a-z0-9._-]{1,63}|[a-z0-9]{1,63}\.blob\.core\.windows\.net)", "review the bucket policy", lead=True),
]
API_CALLS = [
    Rule("XHR request header (auth)", "MEDIUM", r"""setRequestHeader\s{0,5}\(\s{0,5}["'](?:Authorization|X-API-Key|X-Auth-Token|X-Access-Token)["']""", "trace where the value comes from"),
    Rule("Authorization header in request", "MEDIUM", r"""(?i)["']?Authorization["']?\s{0,5}:\s{0,5}["'`](?:Bearer|Basic|Token|JWT)\b""", "trace where the token comes from"),
    Rule("API key header", "MEDIUM", r"""(?i)["']?(?:x-api-key|api[_-]?key|x-auth-token|x-access-token|apikey)["']?\s{0,5}:\s{0,5}["'`]""", "a key in the client is public"),
]
JS_RULES = CRYPTO + AUTHZ + CONFIG + API_CALLS
LEAD_RULES = [r for r in JS_RULES if r.lead]
NOTE_RULES = [r for r in JS_RULES if not r.lead]

# (kind, label, which part, expression)
LIBRARIES = [
    ("third-party", "Google Tag Manager / Analytics / Ads", "host", r"(?:^|\.)(?:googletagmanager\.com|google-analytics\.com|googleadservices\.com|googlesyndication\.com|doubleclick\.net|googleoptimize\.com)$"),
    ("third-party", "Google (static / reCAPTCHA / Maps)", "host", r"(?:^|\.)(?:gstatic\.com|ajax\.googleapis\.com|maps\.googleapis\.com|apis\.google\.com|www\.google\.com|accounts\.google\.com)$"),
    ("third-party", "Public CDN library", "host", r"(?:^|\.)(?:cdnjs\.cloudflare\.com|cdn\.jsdelivr\.net|unpkg\.com|code\.jquery\.com|(?:stackpath|maxcdn|netdna)\.bootstrapcdn\.com|ajax\.aspnetcdn\.com|cdn\.polyfill\.io|polyfill\.io|esm\.sh|cdn\.skypack\.dev)$"),
    ("third-party", "Social / login SDK", "host", r"(?:^|\.)(?:connect\.facebook\.net|platform\.twitter\.com|platform\.linkedin\.com|snap\.licdn\.com|t1\.kakaocdn\.net|developers\.kakao\.com|static\.nid\.naver\.com|appleid\.cdn-apple\.com)$"),
    ("third-party", "Analytics / marketing", "host", r"(?:^|\.)(?:hotjar\.com|clarity\.ms|cdn\.segment\.com|cdn\.mxpnl\.com|mixpanel\.com|amplitude\.com|cdn\.amplitude\.com|braze\.com|appboycdn\.com|branch\.io|appsflyer\.com|criteo\.(?:com|net)|adobedtm\.com|omtrdc\.net|optimizely\.com|wcs\.naver\.net|analytics\.tiktok\.com|static\.ads-twitter\.com|bat\.bing\.com|cdn\.heapanalytics\.com|fullstory\.com|logrocket\.(?:io|com)|cdn\.lr-ingest\.io|datadoghq-browser-agent\.com|js-agent\.newrelic\.com|browser\.sentry-cdn\.com)$"),
    ("third-party", "Chat / support / consent widget", "host", r"(?:^|\.)(?:cdn\.channel\.io|channel\.io|widget\.intercom\.io|js\.intercomcdn\.com|static\.zdassets\.com|zopim\.com|cdn\.cookielaw\.org|cookielaw\.org|onetrust\.com|cookiebot\.com|consent\.cookiebot\.com|js\.hs-scripts\.com|js\.hsforms\.net|js\.stripe\.com|js\.tosspayments\.com|stdpay\.inicis\.com|cdn\.iamport\.kr)$"),
    ("library", "jQuery", "file", r"^jquery(?:[.-][a-z0-9.-]{0,60})?\.js$"),
    ("library", "React", "file", r"^react(?:-dom)?(?:\.(?:production|development|profiling))?(?:\.min)?\.js$"),
    ("library", "Vue", "file", r"^vue(?:\.runtime)?(?:\.global|\.esm-browser|\.common)?(?:\.prod)?(?:\.min)?\.js$"),
    ("library", "AngularJS", "file", r"^angular(?:-[a-z]{1,20})?(?:\.min)?\.js$"),
    ("library", "Utility library", "file", r"^(?:lodash|underscore|moment|dayjs|axios|require|modernizr|hammer|clipboard|crypto-js|purify|dompurify)(?:[.-][a-z0-9.-]{0,40})?\.js$"),
    ("library", "UI library", "file", r"^(?:bootstrap|popper|swiper|slick|select2|sweetalert2?|chart|d3|gsap|three|lottie|aos|fullpage|datatables|jquery\.datatables)(?:[.-][a-z0-9.-]{0,40})?\.js$"),
    ("library", "Polyfill", "file", r"^(?:polyfills?|core-js|babel-polyfill|es[56]-shim|regenerator-runtime|whatwg-fetch)(?:[.-][a-z0-9.-]{0,60})?\.js$"),
    ("vendor", "Vendor chunk", "file", r"^(?:[a-z0-9_]{1,40}[.~-])?(?:vendors?|chunk-vendors|npm\.[a-z0-9@_.-]{1,60})(?:[.~-][a-z0-9_.~-]{0,160})?\.m?js$"),
    ("vendor", "Framework / runtime chunk", "file", r"^(?:framework|polyfills|runtime|webpack-runtime|webpack|main-app-runtime)(?:[.~-][a-z0-9_.~-]{0,160})?\.m?js$"),
    ("library", "jQuery $1", "banner", r"jQuery(?: JavaScript Library)? v(\d{1,2}\.\d{1,2}\.\d{1,2})"),
    ("library", "React", "banner", r"@license React\b"),
    ("library", "Vue $1", "banner", r"Vue\.js v(\d{1,2}\.\d{1,2}\.\d{1,2})"),
    ("library", "Angular $1", "banner", r"@license Angular v(\d{1,2}\.\d{1,2}\.\d{1,2})"),
    ("library", "Lodash", "banner", r"@license Lodash\b|Lodash <https://lodash\.com/>"),
    ("library", "Bootstrap $1", "banner", r"Bootstrap v(\d{1,2}\.\d{1,2}\.\d{1,2})"),
    ("library", "Moment", "banner", r"//! moment\.js"),
    ("library", "core-js polyfill", "banner", r"core-js \d{1,2}\.\d{1,2}|\(c\) 20\d\d-20\d\d Denis Pushkarev"),
    ("library", "Swiper $1", "banner", r"Swiper (\d{1,2}\.\d{1,2}\.\d{1,2})"),
]
BANNER_SCAN = 2048

# (name, expression, how the value gets in, expression that must also occur)
FLOW_SOURCES = [
    ("URL fragment (location.hash)", r"location\.hash", "the URL fragment", ""),
    ("URL query (location.search)", r"""location\.search|["']?\.searchParams\b|new\s{1,5}URLSearchParams""", "a query parameter", ""),
    ("full URL (location.href / document.URL)", r"location\.href|location\.pathname|document\.(?:URL|documentURI|baseURI)", "the request URL", ""),
    ("referrer (document.referrer)", r"document\.referrer", "the Referer header", ""),
    ("window.name", r"window\.name", "window.name of an opener", ""),
    ("postMessage data", r"""addEventListener\s{0,5}\(\s{0,5}["']message["']|onmessage\s{0,5}=|\b(?:e|ev|evt|event|msg|message)\.data\b""", "a message from another origin", r"""addEventListener\s{0,5}\(\s{0,5}["']message["']|onmessage\s{0,5}="""),
    ("cookie (document.cookie)", r"document\.cookie", "a cookie value", ""),
]
# (name, expression, severity, noted even without a source, what to check)
FLOW_SINKS = [
    ("innerHTML/outerHTML", r"\.(?:inner|outer)HTML\s{0,5}=[^=]", "HIGH", False, "check whether markup in the value is rendered"),
    ("document.write", r"\bdocument\.(?:write|writeln)\s{0,5}\(", "HIGH", False, "check whether markup in the value is rendered"),
    ("insertAdjacentHTML", r"\.insertAdjacentHTML\s{0,5}\(", "HIGH", False, "check whether markup in the value is rendered"),
    ("jQuery .html()", r"\.html\s{0,5}\(\s{0,5}[^)\s]", "MEDIUM", False, "check whether markup in the value is rendered"),
    ("location assignment (redirect / javascript:)", r"\blocation\s{0,5}=[^=]|location\.(?:href|assign|replace)\s{0,5}[=(]", "MEDIUM", False, "check which targets are accepted"),
    ("eval()", r"\beval\s{0,5}\(", "HIGH", True, "check whether the argument can be influenced"),
    ("Function constructor", r"\bnew\s{1,5}Function\s{0,5}\(", "HIGH", True, "check whether the argument can be influenced"),
    ("setTimeout/setInterval string", r"""\b(?:setTimeout|setInterval)\s{0,5}\(\s{0,5}["'`]""", "MEDIUM", True, "check whether the argument can be influenced"),
]
NOTE_WINDOW = 600

GUARD_NAME = "Client-side authorization gate -> route"
GUARD_SEVERITY = "MEDIUM"
GUARD_ANCHOR = r"(?i)(?:is_?admin|has_?role|has_?permission|can_?access|requireRole|requireAuth|authGuard|roleGuard|canActivate|beforeEnter|PrivateRoute|ProtectedRoute|RequireAuth|withAuth)\b"
GUARD_TARGET = r"""["'](/[A-Za-z0-9_./:-]{1,60})["']"""
GUARD_NOTE = "confirm that the route's backend checks authorisation itself"
ARGUMENT_NAME = "Embedded crypto key/IV -> value"
ARGUMENT_SEVERITY = "HIGH"
ARGUMENT_ANCHOR = r"CryptoJS\.|crypto\.subtle\.|(?:new\s{1,5})?JSEncrypt\s{0,5}\(|forge\.(?:cipher|aes|rsa|des)|sjcl\.(?:encrypt|decrypt)"
ARGUMENT_TARGET = r"""["'](?!(?:RSA|AES|SHA|HMAC|PKCS|ECDSA|ECDH|PBKDF|HKDF|DES|RC4|X25519|Ed25519)[A-Za-z0-9_-]{0,60}["'])([A-Za-z0-9+/=_-]{16,64})["']"""
ARGUMENT_NOTE = "move the key out of the client"

JS_KEYWORDS = [
    "var", "let", "const", "function", "return", "if", "else", "for", "while", "do", "switch", "case", "default",
    "break", "continue", "new", "delete", "typeof", "void", "in", "of", "instanceof", "this", "null", "undefined",
    "true", "false", "try", "catch", "finally", "throw", "class", "extends", "super", "import", "export", "async",
    "await", "yield", "with", "debugger", "static", "get", "set",
]
FLOW_AUTH_HEADER = r"(?i)^(?:authorization|x-api-key|api-?key|x-auth-token|x-access-token|access-?token|token|x-token|x-jwt)$"
HTTP_VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
HANDLER_KEY = r"^on[A-Z][A-Za-z]{1,30}$"
ROUTE_COMPONENT_KEYS = [
    "component", "element", "loader", "action", "view", "page", "render", "Component", "lazy", "components",
    "beforeEnter", "resolve",
]
