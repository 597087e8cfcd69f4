"""Fixed values that must equal the original pipelines' for identical results.

Everything here is data, stated plainly and in its natural order. The logic that
uses it lives in ``functions/`` and ``operators/``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — link lists per registry (internal hosts, URL shorteners)
# ---------------------------------------------------------------------------
INTERNAL_HOSTS = {
    "image": ["docker.com"],
    "npm": ["npmjs.com", "npmjs.org"],
    "nuget": ["nuget.org"],
}
SHORT_HOSTS = {
    "image": ["bit.ly", "tinyurl.com", "goo.gl", "t.co", "t.me", "t.ly", "ow.ly", "tiny.cc",
              "tinybit.cc", "is.gd", "page.link", "blltly.com", "tinurli", "shurll"],
    "npm": ["bit.ly", "tinyurl.com", "goo.gl", "t.co", "t.me", "t.ly", "ow.ly", "tiny.cc",
            "tinybit.cc", "is.gd", "page.link"],
    "nuget": ["bit.ly", "tinyurl.com", "goo.gl", "t.co", "t.me", "t.ly", "ow.ly", "tiny.cc",
              "tinybit.cc", "is.gd", "page.link", "blltly.com"],
}

# ---------------------------------------------------------------------------
# FIXED VALUES — image-file suffixes that mark a media URL (case-sensitive)
# ---------------------------------------------------------------------------
IMAGE_SUFFIXES = [".bmp", ".jpg", ".jpeg", ".png", ".tif", ".gif", ".pcx", ".tga", ".exif",
                  ".fpx", ".svg", ".psd", ".cdr", ".pcd", ".dxf", ".ufo", ".eps", ".ai", ".raw",
                  ".WMF", ".webp", ".avif", ".apng", ".ico", ".bgpng", ".bgjpg"]

# ---------------------------------------------------------------------------
# FIXED VALUES — platform vocabularies (20 words each, in rank order)
# ---------------------------------------------------------------------------
PLATFORM_WORDS = {
    "docker": ["docker", "image", "run", "container", "images", "use", "software", "consul",
               "file", "information", "server", "base", "containers", "history", "contained",
               "source", "running", "start", "size", "version"],
    "npm": ["npm", "version", "published", "project", "registry", "package", "running", "start",
            "projects", "javascript", "packages", "manager", "install", "use", "months", "years",
            "command", "days", "file", "modules"],
    "nuget": ["nuget", "microsoft", "cli", "windows", "studio", "use", "pack", "package", "engine",
              "mac", "install", "dotnet", "framework", "license", "graphics", "store", "generate",
              "source", "distributed", "api"],
}

# FIXED VALUES — stop words added on top of the general English list
EXTRA_STOP_WORDS = ["br", "http", "https", "com", "cn", "org"]

# FIXED VALUES — closing tags whose presence means "HTML, not markdown"
HTML_TAGS = ["</p>", "</li>", "</ol>", "</a>", "</h1>", "</h2>", "</h3>", "</h4>", "</h5>",
             "</h6>", "<br>"]

# FIXED VALUES — README member names, in the order each registry tries them
NPM_README_NAMES = ["package/README.md", "package/readme.md", "package/Readme.md",
                    "package/README.MD"]  # first present wins
NUGET_README_NAMES = ["readme.md", "Readme.md", "README.md"]  # last present wins

# FIXED VALUES — numeric constants
RANK_SCALE = 1_000_000.0       # score = 1 - rank / RANK_SCALE
CONTEXT_DECAY = (0.6, 0.4)     # weights of the previous and the one-before-previous package
NUGET_MIN_TEXT = 20            # stripped text shorter than this is not scored
SEMANTIC_WIDTH = 10            # width of the platform-distance block
RESULT_TEXT_WIDTH = 95         # result columns cut to this many characters
URL_WIDTH = {"image": 255, "npm": 254}

# ---------------------------------------------------------------------------
# FIXED VALUES — regular expressions (Java syntax; RE2 accepts the same text)
# ---------------------------------------------------------------------------
# Feature URL. The original alternation admits exactly: ASCII letters, digits,
# '!' and every character in the range '$'..'_' (which covers digits, upper case,
# %&'()*+,-./:;<=>?@[\]^_). A single character class is equivalent and faster.
URL_FEATURE = r"https?://[!$-_a-z]+"
# NuGet scoring gate: anything but whitespace, ';', '(', ')' and '"'.
URL_GATE = r"https?://[^\s;()\"]+"
# Promoted-link patterns: markdown link target, HTML href value.
MD_LINK = r"\[[^\]]+\]\(([^)]+)\)"
HREF = r"href=['\"]?([^'\" >]+)"
# Corpus audit: a feature URL followed by one of ;().whitespace, or ending right
# after "http" (look-around: Java regex only, no DuckDB twin).
URL_AUDIT = r"https?://[!$-_a-z]+(?=[;().\s]|(?<=http))"
# Fenced code blocks (dot matches newline, non-greedy).
CODE_BLOCK = r"(?s)```.*?```|~~~.*?~~~"
# Network location of a URL (what urllib's netloc returns for these URLs).
NETLOC = r"^https?://([^/?#]*)"

# Network location for any scheme (homepage / project URLs).
NETLOC_ANY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
# Catalog record status values.
STATUS_UNLISTED, STATUS_NORMAL = 0, 1
