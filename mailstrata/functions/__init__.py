"""Column functions. All are Catalyst expressions; nothing here starts a Python worker."""

from mailstrata.functions.auth import (
    balanced_comment,
    domain_of,
    known_auth_result,
    org_domain,
    split_outside_parens,
)
from mailstrata.functions.content import (
    evidence_id,
    extension_chain,
    identify_bytes,
    sha256_hex,
)
from mailstrata.functions.dates import iso_utc, rfc5322_epoch, rfc5322_ts
from mailstrata.functions.ip import canonical_ip, ip_hex, ip_version, is_private_ip
from mailstrata.functions.text import (
    clean_url_text,
    defang_text,
    defang_url,
    looks_defanged,
    truncate_display,
    undefang_url,
    url_spellings,
)
from mailstrata.functions.urls import url_dedup_key, url_struct

__all__ = [
    "balanced_comment", "canonical_ip", "clean_url_text", "defang_text", "defang_url",
    "domain_of", "evidence_id", "extension_chain", "identify_bytes", "ip_hex", "ip_version",
    "is_private_ip", "iso_utc", "known_auth_result", "looks_defanged", "org_domain",
    "rfc5322_epoch", "rfc5322_ts", "sha256_hex", "split_outside_parens", "truncate_display",
    "undefang_url", "url_dedup_key", "url_spellings", "url_struct",
]
