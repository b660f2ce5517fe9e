"""Row-at-a-time statements of the rules, used as a second opinion on small data."""

import re
import unicodedata


def normalize(name):
    text = "".join(c for c in unicodedata.normalize("NFD", name or "") if unicodedata.category(c) != "Mn")
    return " ".join(re.sub(r"[^\w\s]", " ", text).split()).upper()


def normalize_number(number):
    return re.sub(r"[\s\-.,/]", "", number or "").upper()


def lcs(a, b):
    previous = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(previous[j] + 1 if x == y else max(previous[j + 1], row[j]))
        previous = row
    return previous[-1]


def ratio(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def year(text):
    found = re.search(r"\d{4}", text or "")
    return int(found.group()) if found else None


def is_short(name):
    words = name.split()
    return (len(words) <= 2 and len(name) < 10) or any(len(w) <= 2 for w in words)


def short_threshold(name, config):
    adaptive = config.adaptive
    if not adaptive.enabled:
        return config.short_name_threshold, "default"
    bare = name.replace(".", "").replace(" ", "")
    if len(bare) <= 4 and bare.isupper() and bare.isalpha():
        return adaptive.latin_initials, "latin_initials"
    letters = [c for c in name if c.isalpha()]
    for script, low, high, value in (
        ("chinese", "一", "鿿", adaptive.chinese), ("arabic", "؀", "ۿ", adaptive.arabic),
        ("cyrillic", "Ѐ", "ӿ", adaptive.cyrillic),
    ):
        if letters and sum(low <= c <= high for c in letters) / len(letters) > 0.5:
            return value, f"{script}_name"
    return config.short_name_threshold, "latin_default"


def nationality(request, entity):
    asked = [v.upper() for v in (request["nationality"], request["country"]) if v]
    known = {v.upper() for v in [*entity["countries"], entity["nationality"], entity["citizenship"]] if v}
    if set(asked) & known:
        return "NATIONALITY_EXACT_MATCH_INFO"
    for a in asked:
        for k in known:
            if min(len(a), len(k)) >= 4 and (k.startswith(a) or k.endswith(a) or a.startswith(k) or a.endswith(k)):
                return "NATIONALITY_SUBSTRING_MATCH_INFO"
    return None


def screen(request, entities, config):
    """[(source, entity_id, overall, layer, flags, recommendation, matched_name, matched_document)]"""
    number, kind = request["document_number"], request["document_type"]
    wanted = normalize_number(number)
    hits, seen = [], set()
    for e in entities:
        same = [d for d in e["identity_documents"] if wanted and normalize_number(d["number"]) == wanted]
        found = next((d["number"] for d in same if kind is None or d["type"].upper() == kind.upper()), None)
        if found is None and wanted and e["vessel_imo"] and normalize_number(e["vessel_imo"]) == wanted:
            found = e["vessel_imo"]
        if found is not None:
            seen.add((e["source"], e["entity_id"]))
            hits.append((e["source"], e["entity_id"], 100.0, 1, ["DOCUMENT_EXACT_MATCH"], "AUTO_ESCALATE", e["primary_name"], found))
    query = normalize(request["name"])
    short = is_short(request["name"])
    threshold, reason = short_threshold(request["name"], config) if short else (config.name_threshold, "default")
    common = query in {normalize(n) for n in config.common_names}
    w, layers, rec = config.weights, config.layers, config.recommendations
    for e in entities if query else []:
        if (e["source"], e["entity_id"]) in seen:
            continue
        best, matched = 0.0, ""
        for name in e["all_names"]:
            score = ratio(query, normalize(name))
            if score > best:
                best, matched = score, name
        if best < layers.low:
            continue
        document = next((d["number"] for d in e["identity_documents"] if wanted and normalize_number(d["number"]) == wanted), None)
        doc_score = 100.0 if document is not None else 0.0
        a, b = year(request["date_of_birth"]), year(e["date_of_birth"])
        dob = max(0, 100 - 20 * abs(a - b)) if a and b else 0
        nat = nationality(request, e)
        overall = max(0, min(100, best * w.name + doc_score * w.document + dob * w.dob))
        layer, flags = 4, []
        if doc_score == 100:
            layer = 1
            flags.append("DOCUMENT_MATCH")
        elif best >= layers.high:
            layer = 2 if nat or dob >= 60 else 3
        elif best >= layers.moderate:
            layer = 3
        if short:
            flags.append("SHORT_NAME_QUERY")
            if reason not in ("default", "latin_default"):
                flags.append("ADAPTIVE_THRESHOLD_" + reason.upper())
        if common:
            flags.append("COMMON_NAME")
        if nat:
            flags.append(nat)
        if doc_score == 0 and number:
            flags.append("NO_DOCUMENT_MATCH")
        if e["entity_type"] == "entity":
            flags.append("ENTITY_MATCH")
        advice = (
            "AUTO_ESCALATE" if overall >= rec.escalate else "MANUAL_REVIEW" if overall >= rec.review
            else "LOW_CONFIDENCE_REVIEW" if overall >= rec.clear else "AUTO_CLEAR"
        )
        if common and doc_score == 0:
            advice = "MANUAL_REVIEW" if advice == "AUTO_ESCALATE" else advice
            flags.append("COMMON_NAME_REQUIRES_SECONDARY_VALIDATION")
        if overall >= threshold or doc_score == 100:
            hits.append((e["source"], e["entity_id"], overall, layer, flags, advice, matched, document))
    hits.sort(key=lambda h: (-h[2], h[3], h[0], h[1]))
    return hits[: config.match_limit]
