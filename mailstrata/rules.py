"""Word lists, lookup tables, patterns and formats of the analysis.

They are data, equal by necessity to the values the analysis is defined by; everything that
reads them is in ``functions`` and ``operators``.
"""

from __future__ import annotations

# --- identity -----------------------------------------------------------------------------
EVIDENCE_PREFIX = "PS-MSG-"
EVIDENCE_HEX_DIGITS = 12

# --- headers ------------------------------------------------------------------------------
LIST_HEADERS = (
    "list-id", "list-unsubscribe", "list-post", "list-owner",
    "list-help", "list-archive", "list-subscribe", "list-unsubscribe-post",
)
ROUTING_HEADERS = (
    "message-id", "x-originating-ip", "x-sender-ip", "x-mailer", "user-agent", "mime-version",
)
ADDRESS_ROLES = ("from", "to", "cc", "reply-to", "return-path")
RECEIVED_KEYWORDS = ("from", "by", "with", "id", "for", "via")

# RFC 5322 obsolete zone names as signed hhmm.
ZONE_HHMM = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "AST": -400, "ADT": -300, "EST": -500, "EDT": -400,
    "CST": -600, "CDT": -500, "MST": -700, "MDT": -600, "PST": -800, "PDT": -700,
}
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

# Internal-use networks; documentation ranges are deliberately absent.
PRIVATE_NETWORKS = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16",
    "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10",
    "::1/128", "fe80::/10", "fc00::/7",
)

# --- authentication -----------------------------------------------------------------------
KNOWN_AUTH_RESULTS = (
    "pass", "fail", "none", "neutral", "softfail", "temperror", "permerror", "policy",
)
AUTH_METHOD_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"
CLAIM_DOMAIN_KEYS = (
    "header.i", "header.d", "header.from", "smtp.mailfrom", "envelope-from", "mailfrom",
)
DISPLAY_DOMAIN_KEYS = CLAIM_DOMAIN_KEYS[:-1]
SPF_DOMAIN_KEYS = ("smtp.mailfrom", "envelope-from", "mailfrom")
DKIM_DOMAIN_KEYS = ("header.i", "header.d")
DKIM_NAMED_TAGS = ("d", "s", "a", "c", "h", "bh")

# --- URLs ---------------------------------------------------------------------------------
DEFAULT_PORTS = {"http": 80, "https": 443}
SHORTENER_DOMAINS = (
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "cutt.ly",
    "rb.gy", "rebrand.ly", "shorturl.at", "tiny.cc", "bl.ink", "lnkd.in", "s.id", "t.ly",
    "v.gd", "qr.ae", "shorte.st", "adf.ly",
)
MANY_QUERY_PARAMS = 5
DEEP_SUBDOMAIN = 4
TRUNCATION_MARK = ("… [", " more chars, see --json]")
# Characters whose NFKC form holds one of "/?#@:"; such a host is not parseable.
CONFUSABLE_NETLOC_CHARS = (
    "⁇⁈⁉℀℁℅℆⩴︓︖﹕﹖﹟﹫"
    "＃／：？＠"
)

# --- attachments --------------------------------------------------------------------------
# Leading bytes, first match wins: (magic, category, label, what the bytes are). Fixed values, the texts included.
MAGIC_TABLE = (
    (b"MZ", "executable", "windows-pe", "MZ header (PE executable)"),
    (b"\x7fELF", "executable", "elf", "ELF magic (Unix executable)"),
    (b"%PDF-", "document", "pdf", "PDF header"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "document", "ole", "OLE compound-file signature (legacy Office)"),
    (b"PK\x03\x04", "archive", "zip", "ZIP local file header"),
    (b"PK\x05\x06", "archive", "zip-empty", "ZIP end-of-central-directory only"),
    (b"PK\x07\x08", "archive", "zip-spanned", "ZIP data descriptor signature"),
    (b"\x1f\x8b", "archive", "gzip", "gzip magic"),
    (b"Rar!\x1a\x07\x00", "archive", "rar", "RAR signature"),
    (b"7z\xbc\xaf\x27\x1c", "archive", "sevenzip", "7z signature"),
    (b"\x89PNG\r\n\x1a\n", "image", "png", "PNG signature"),
    (b"\xff\xd8\xff", "image", "jpeg", "JPEG SOI marker"),
    (b"GIF87a", "image", "gif", "GIF87a header"),
    (b"GIF89a", "image", "gif", "GIF89a header"),
    (b"BM", "image", "bmp", "BMP magic"),
    (b"II*\x00", "image", "tiff", "TIFF little-endian magic"),
    (b"MM\x00*", "image", "tiff", "TIFF big-endian magic"),
    (b"{\\rtf", "document", "rtf", "RTF header"),
    (b"<?xml", "text", "xml", "XML declaration"),
    (b"#!/", "executable", "script", "shebang line (executable script)"),
)
# Outcomes that do not come from a magic: label -> (category, detail).
OTHER_CONTENT = {
    "empty": ("empty", "zero-length content"),
    "html": ("text", "HTML tag at start of content"),
    "text": ("text", "printable text, no binary magic"),
    "unknown": ("unknown", "no known magic bytes; not printable text"),
}
PRINTABLE_SHARE = 0.9

EXECUTABLE_EXTENSIONS = (
    "exe", "dll", "scr", "com", "pif", "cpl", "msi", "bat", "cmd",
    "ps1", "vbs", "vbe", "js", "jse", "wsf", "wsh", "jar", "apk",
)
MACRO_EXTENSIONS = (
    "docm", "xlsm", "pptm", "dotm", "xltm", "potm", "xlam", "doc", "xls", "ppt",
)
ARCHIVE_EXTENSIONS = ("zip", "rar", "7z", "gz", "tar", "cab")
PLAIN_TEXT_EXTENSIONS = ("txt", "csv", "log", "md")

# Extensions -> content labels that agree with them.
EXTENSION_LABELS = (
    (EXECUTABLE_EXTENSIONS, ("windows-pe", "elf", "script")),
    (MACRO_EXTENSIONS, ("zip", "ole")),
    (ARCHIVE_EXTENSIONS, ("zip", "zip-empty", "gzip", "rar", "sevenzip")),
    (("pdf",), ("pdf",)),
    (("png",), ("png",)),
    (("jpg", "jpeg"), ("jpeg",)),
    (("gif",), ("gif",)),
    (("bmp",), ("bmp",)),
    (("tiff",), ("tiff",)),
    (("html", "htm"), ("html",)),
    (PLAIN_TEXT_EXTENSIONS, ("text", "xml", "script")),
)
# Content label -> declared types that agree with it.
LABEL_MIME_TYPES = {
    "windows-pe": ("application/x-msdownload", "application/x-dosexec"),
    "elf": ("application/x-elf", "application/x-executable"),
    "script": ("application/x-sh", "text/x-sh", "application/javascript"),
    "pdf": ("application/pdf",),
    "zip": ("application/zip", "application/x-zip-compressed"),
    "ole": ("application/x-ole-storage", "application/msword", "application/vnd.ms-office"),
    "gzip": ("application/gzip", "application/x-gzip"),
    "rar": ("application/vnd.rar", "application/x-rar-compressed"),
    "sevenzip": ("application/x-7z-compressed",),
    "png": ("image/png",),
    "jpeg": ("image/jpeg",),
    "gif": ("image/gif",),
    "bmp": ("image/bmp",),
    "tiff": ("image/tiff",),
    "html": ("text/html",),
    "xml": ("text/xml", "application/xml"),
    "text": ("text/plain",),
    "rtf": ("application/rtf", "text/rtf"),
}
GENERIC_MIME_TYPES = ("application/octet-stream", "application/binary")
NESTED_ARCHIVE_SUFFIXES = (
    ".zip", ".jar", ".docx", ".xlsx", ".pptx", ".pptm", ".docm", ".xlsm",
)
