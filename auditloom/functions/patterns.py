"""Patterns of the text operators, in RE2's dialect, as their SQL reads them; ``java`` makes of one what Java reads the same.

Look-ahead is avoided: the one rule that needs context asks for it by a second pattern.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import product

_W = "[A-Za-z0-9_]"
_BREAK = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)
#: Characters outside ASCII that RE2 takes for a letter whatever its case.
_FOLDS = {"s": "\u017f", "k": "\u212a"}


def _starts(rest: str) -> bool:
    """Whether all that a pattern matches surely begins with a word character."""
    if rest[:1] == "(":
        depth, parts = 0, [""]
        for t in _TOKEN.findall(rest):
            depth += {"(": 1, ")": -1}.get(t, 0)
            if not depth:
                break
            if t == "|" and depth == 1:
                parts.append("")
            else:
                parts[-1] += t
        after = rest[len("|".join(parts)) + 1 :]
        parts[0] = parts[0].removeprefix("(?:")
        return after[:1] not in ("?", "*", "{") and all("(" not in x[:1] and _starts(x) for x in parts)
    first = re.match(r"[A-Za-z0-9_]|\\[dw]|\[[A-Z](?:-[A-Z])?\]", rest)
    more = rest[first.end() :] if first else ""
    return first is not None and more[:1] not in ("?", "*") and not more.startswith("{0")


@cache
def java(pattern: str) -> str:
    """The pattern for Java, whose ``\\b`` sees letters of all scripts as words, whose ``\\s`` has the vertical tab, whose dot stops at more than a line feed and whose ``(?i)`` knows ASCII only."""
    fold, out, at = pattern.startswith("(?i)"), [], 0
    for m in _TOKEN.finditer(pattern):
        t, at = m.group(), m.end()
        if t == "\\b":
            t = f"(?<!{_W})" if _starts(pattern[at:]) else _BREAK
        elif t == "\\s":
            t = "[\\t\\n\\f\\r ]"
        elif t == ".":
            t = "[^\\n]"
        elif t[0] == "[" and len(t) > 1:
            t = re.sub(r"(?<!\\)\\s", r"\\t\\n\\f\\r ", t)
            if fold:
                try:
                    t = t[:-1] + "".join(c for k, c in _FOLDS.items() if t[1] != "^" and re.match(t, k, re.I)) + "]"
                except re.error:  # a class in braces' notation
                    pass
        elif fold and t.lower() in _FOLDS and pattern[m.start() - 2 : m.start()] != "(?":
            t = f"[{t}{_FOLDS[t.lower()]}]"
        out.append(t)
    return "".join(out)


#: Strings that ``needs`` tries for one pattern at most: a search for a few strings costs less than a pattern, one for many does not.
NEEDED = 40


def _whole_set(op, arg) -> set[str] | None:
    """All that a part of a parsed pattern matches, if that is a few strings."""
    name = str(op)
    if name == "AT":
        return {""}
    if name == "LITERAL":
        return {chr(arg)}
    if name == "IN" and [str(x) for _, x in arg] == ["CATEGORY_DIGIT"]:
        return {"0"}
    if name == "IN" and len(arg) <= NEEDED and all(str(o) == "LITERAL" for o, _ in arg):
        return {chr(c) for _, c in arg}
    if name == "SUBPATTERN":
        return _joined(arg[-1])
    if name == "MAX_REPEAT" and arg[0] == arg[1] and arg[0] < NEEDED:
        return _joined([*arg[-1]] * arg[0])
    if name == "BRANCH":
        each = [_joined(x) for x in arg[1]]
        return set().union(*each) if None not in each and sum(map(len, each)) <= NEEDED else None
    return None


def _joined(parts) -> set[str] | None:
    out = {""}
    for op, arg in parts:
        more = _whole_set(op, arg)
        if more is None or len(out) * len(more) > NEEDED:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def _needed(parts) -> set[str]:
    """Of the sets of strings of which all matches of the parts have one, that with the longest strings; empty if there is none."""
    found, run = [], {""}
    for op, arg in parts:
        more = _whole_set(op, arg)
        if more is not None and len(run) * len(more) <= NEEDED:
            run = {a + b for a, b in product(run, more)}
            continue
        name, repeated = str(op), None
        if name in ("MAX_REPEAT", "MIN_REPEAT") and 0 < arg[0] < NEEDED:
            repeated = _joined([*arg[-1]] * arg[0])
        found.append({a + b for a, b in product(run, repeated)} if repeated and len(run) * len(repeated) <= NEEDED else run)
        run = more or repeated or {""}
        if more is None:
            if name == "SUBPATTERN" or (name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0):
                found.append(_needed(arg[-1]))
            elif name == "BRANCH":
                each = [_needed(x) for x in arg[1]]
                if all(each) and sum(map(len, each)) <= NEEDED:
                    found.append(set().union(*each))
    found = [x for x in (*found, run) if x and "" not in x]
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=set())


@cache
def needs(pattern: str) -> tuple[bytes, ...]:
    """Strings of which every match of the pattern holds one when both are ``folded``; none if there are no such few strings."""
    try:
        parts = re._parser.parse(pattern)
    except re.error:  # RE2's own notation
        return ()
    return tuple(sorted({folded(x) for x in _needed(parts)}))


_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def folded(text: str) -> bytes:
    """A text in small letters and with one digit, also for the letters that fold to one in ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b"\xe2\x84\xaa", b"k").replace(b"\xc5\xbf", b"s")


def possible(text: str, patterns: list[str]) -> int:
    """The patterns (62 at most), as bits, that can match a text by the strings they need."""
    t, out = folded(text), 0
    for k, p in enumerate(patterns):
        strings = needs(p)
        if not strings or any(x in t for x in strings):
            out |= 1 << k
    return out


SEP = r"[-.\s]?"
GAP = r"\s+"


def d(low: int, high: int | None = None) -> str:
    """That many digits."""
    return rf"\d{{{low}}}" if high is None else rf"\d{{{low},{high}}}"


def whole(*parts: str) -> str:
    """The parts in a row, between word boundaries."""
    return r"\b" + "".join(parts) + r"\b"


def any_of(words: str) -> str:
    """One of the words of a string, in alphabetical order; '_' stands for white space."""
    return "(?:" + "|".join(sorted(w.replace("_", GAP) for w in words.split())) + ")"


def may(words: str) -> str:
    """One of the words and white space, or nothing."""
    return "(?:" + any_of(words) + GAP + ")?"


def phrase(*parts: str) -> str:
    """Parts with white space between, whatever their case; a part that ends in ')?' brings its own."""
    out = "(?i)"
    for k, p in enumerate(parts):
        out += p if k == len(parts) - 1 or p.endswith(")?") else p + GAP
    return out


_UP, _HEX = "[A-Z]", "[0-9a-fA-F]"
_MAIL = r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
_MONTH, _DAY, _YEAR = "(?:1[0-2]|0[1-9])", "(?:3[01]|[12]\\d|0[1-9])", "(?:20|19)" + d(2)

#: Gate: PII kind -> (pattern, policy terms that turn it on). The order is that of redaction.
GATE_PII: dict[str, tuple[str, set[str]]] = {
    "ssn": (whole(d(3), SEP, d(2), SEP, d(4)), {"ssn", "social security number", "social security"}),
    "passport": (whole(_UP, "{1,2}", d(6, 9)), {"travel document", "passport number", "passport"}),
    "drivers_license": (whole(_UP, d(3), SEP, d(4), SEP, d(4)), {"license number", "drivers license", "driver's license"}),
    "credit_card": (whole("(?:", d(4), SEP, "){3}", d(4)), {"credit", "card number", "credit card"}),
    "iban": (whole(_UP, "{2}", d(2), "[A-Z0-9]{4}", d(7), "[A-Z0-9]{0,16}"), {"wire transfer", "iban", "account number", "bank account"}),
    "bank_routing": (whole(d(9)), {"bank account", "aba number", "routing number"}),
    "dollar_amount": (r"\$\s?\d[\d,]*(?:\." + d(2) + ")?", set("wage income cost price expense revenue compensation salary".split()) | {"bank account"}),
    "bitcoin_address": (whole("(?:[13]|bc1)", "[a-km-zA-HJ-NP-Z0-9]{25,39}".replace("a-km-z", "a-z")), {"wallet", "cryptocurrency", "crypto", "bitcoin"}),
    "email_address": (whole(_MAIL), {"email address", "e-mail", "email"}),
    "phone_us": (r"\b(?:\+?1" + SEP + r")?\(?" + d(3) + r"\)?" + SEP + d(3) + SEP + d(4) + r"\b", {"telephone", "phone number", "phone"}),
    "phone_intl": (r"\+" + d(1, 3) + SEP + d(1, 4) + SEP + d(4, 10) + r"\b", {"mobile", "telephone", "phone number", "phone"}),
    "ip_address": (whole(r"\.".join([d(1, 3)] * 4)), {"ip", "ip address"}),
    "ipv6_address": (whole("(?:", _HEX, "{1,4}:){7}", _HEX, "{1,4}"), {"ipv6", "ip", "ip address"}),
    "aws_key": (whole("AKIA", "[A-Z0-9]{16}"), {"credential", "access key", "api key", "aws"}),
    "api_secret": ("(?i)" + whole(any_of("api pk sk"), "[-_]", any_of("prod test live"), "[-_]", "[a-z0-9]{16,}"), {"token", "credential", "secret key", "api key"}),
    "icd10_code": (whole(_UP, d(2), r"(?:\.", d(1, 4), ")?"), {"condition", "medical code", "icd", "diagnosis"}),
    "medical_record": ("(?i)" + r"\b(?:MR#|MRN|Patient\s*#)\s*:?\s*" + d(5, 12) + r"\b", {"patient number", "patient id", "mrn", "medical record"}),
    "npi_number": ("(?i)" + r"\bNPI\s*:?\s*" + d(10) + r"\b", {"physician", "provider", "npi"}),
    "date_of_birth": (whole(_MONTH, r"[/\-]", _DAY, r"[/\-]", _YEAR), {"birth date", "birthday", "dob", "date of birth"}),
}
#: A nine-digit number counts as a routing number only where one of these follows in its line.
ROUTING_CONTEXT = "(?i)" + whole(d(9)) + ".*" + any_of("transit aba routing")

#: Second tier: structured fields, with other patterns than the gate's.
STRUCTURED: dict[str, str] = {
    "ssn": whole("-".join([d(3), d(2), d(4)])),
    "credit_card": whole(r"(?:\d[- ]*){13,19}"),
    "email": whole(_MAIL),
    "phone_us": r"\b(?:\+1" + SEP + r")?\(?" + d(3) + r"\)?" + SEP + d(3) + SEP + d(4) + r"\b",
    "icd10": whole(_UP, d(2), r"(?:\.", d(1, 4), ")?"),
    "date_of_birth": whole(_MONTH, "/", _DAY, "/", _YEAR),
    "ip_address": whole("(?:", d(1, 3), r"\.){3}", d(1, 3)),
}

_STEM = r"\b"


def _terms(words: str, stems: str = "", phrases: str = "") -> str:
    """Whole words, word beginnings, and phrases ('_' for a blank), whatever their case."""
    parts = [r"\b" + any_of(words).replace(GAP, " ") + r"\b"]
    if stems:
        parts.append(r"\b" + any_of(stems))
    if phrases:
        parts.append(r"\b" + any_of(phrases).replace(GAP, " ") + r"\b")
    return "(?i)(?:" + "|".join(parts) + ")"


#: Domain -> one pattern of its keywords.
DOMAINS: dict[str, str] = {
    "health": _terms("health medical treatment prescription hospital doctor patient cancer disease medication therapy chemotherapy copay insurer deductible allergy vaccine", "diagnos symptom surg clinic immuniz", "mental_health"),
    "finance": _terms("401k account bonus budget compensation credit debit equity finance financial income ira loan mortgage payroll portfolio revenue tax transaction", "bank invest salar wage", "net_worth"),
    "legal": _terms("attorney compliance contract court custody defendant divorce indictment lawsuit lawyer legal litigation plaintiff settlement subpoena", "regulat"),
    "identity": _terms("address biometric dob fingerprint passport ssn", "", "date_of_birth driver.?s?_license government_id national_id passport_number phone_number social_security tax_id"),
    "schedule": _terms("appointment calendar meeting schedule", "availab", "free_time"),
    "social": _terms("chat friend group message social", "hobb prefer"),
}

_EARLIER, _RULES = any_of("above previous prior"), any_of("instructions? prompts? rules?")
_AI = any_of("agent ai assistant model")
_ANY = any_of("all every next other subsequent")
#: Injection families -> patterns.
INJECTION: dict[str, list[str]] = {
    "role_override": [
        phrase("ignore", may("all"), _EARLIER, _RULES),
        phrase("forget", any_of("all everything"), any_of("above before previous")),
        phrase("you", "are", "now", any_of("a an"), ""),
        phrase("new", r"instructions?\s*:"),
        r"(?i)system\s*:\s*you",
        phrase("override", any_of("safety security system"), any_of("instructions? prompt settings?")),
        phrase("disregard", any_of("all the your"), any_of("previous prior safety")),
        phrase("act", "as", "if", "you", "(?:don't" + GAP + "have|have" + GAP + "no)", any_of("restrictions? rules?")),
    ],
    "delimiter_escape": [r"(?i)```\s*system", r"<\|im_start\|>", r"<\|system\|>", r"(?i)\[INST\]", "<<SYS>>", r"<\|endoftext\|>", r"(?i)Human:\s*\n\s*Assistant:", r"(?i)###\s*" + any_of("Assistant Human Instruction System") + r"\s*:"],
    "indirect": [
        phrase("when", may("the"), _AI, any_of("process(?:es)? reads? sees?".replace("process(?:es)?", "processe?s?")), "this"),
        phrase("if", "you", "are", "(?:an?" + GAP + ")?", any_of("agent ai assistant language_model llm")),
        phrase("attention", _AI) + r"\s*[:\-]",
        phrase("hidden", r"instruction\s*:"),
        "[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]",
        "[\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]",
    ],
    "tool_injection": [
        phrase(any_of("call execute run"), may("this"), any_of("command function tool") + r"\s*:"),
        r"(?i)import\s+os\s*;?\s*os\." + any_of("exec popen system"),
        r"(?i)subprocess\." + any_of("Popen call run"),
        r"(?i);\s*" + any_of("del drop exec rm truncate") + GAP,
        r"\$\(.*\)",
        "`[^`]*`",
    ],
    "exfiltration": [
        r"!\[.*?\]\(https?://[^\s)]*\{.*?\}",
        r"!\[.*?\]\(https?://[^\s)]*[?&]" + any_of("d data exfil payload q") + "=",
        phrase(any_of("fetch load open request visit"), may("this"), any_of("image link url") + r"\s*:?\s*https?://"),
        r"(?i)<img[^>]+src\s*=\s*[" + "\"']https?://[^\"']*[?&]" + any_of("data id token") + "=",
        phrase("send", any_of("all the this"), r"(?:\w+" + GAP + ")?", any_of("contents? data details files? info response text"), "to", "https?://"),
    ],
    "prompt_infection": [
        phrase(any_of("copy forward include pass propagate repeat spread"), any_of("these this"), any_of("instructions? message prompt text"), any_of("in into to"), _ANY),
        phrase("when", may("you"), any_of("answer communicate reply respond"), "to", any_of("another any other"), any_of("agent ai assistant bot")),
        phrase(any_of("add append embed insert"), any_of("the_following this"), any_of("in into to"), any_of("all every your"), any_of("message output reply response")),
        phrase("instruct", may("the"), any_of("next other receiving"), any_of("agent assistant bot")),
    ],
    "memory_attack": [
        phrase(any_of("memorize remember save store"), any_of("that the_following this"), any_of("for in"), any_of("all every future later")),
        phrase(any_of("change modify update"), any_of("the your"), any_of("context instructions? knowledge memory")),
        phrase(any_of("always forever from_now_on permanently"), may("you"), any_of("must shall should will")),
        phrase(any_of("add create set"), may("a"), any_of("lasting permanent persistent"), any_of("instruction memory note rule")),
    ],
    "encoding_evasion": [
        "(?i)" + any_of("b64 base64 decode") + r"\s*[\(:]\s*[a-z0-9+/]{20,}={0,2}",
        r"(?:\\x" + _HEX + "{2}){5,}",
        "(?i)" + any_of("caesar cipher decode rot13") + r"\s*[\(:]\s*[a-z\s]{10,}",
        r"(?:\\u" + _HEX + "{4}){4,}",
    ],
    "cross_agent_forgery": [
        phrase(any_of("activate call invoke trigger use"), may("the"), any_of("agent api function plugin tool"), r"(?:named?" + GAP + ")?", r"['\"]?\w+['\"]?", any_of("passing using with")),
        phrase(any_of("impersonate impersonating on_behalf_of pretending_to_be"), may("the"), any_of("admin agent system user")),
        "(?i)" + any_of("auth authorization bearer oauth") + r"\s*" + any_of("header key token") + r"\s*[:=]",
    ],
}
