"""product.yaml files: products, their databases, schedules and declared dependencies."""

from __future__ import annotations

import yaml


class ProductError(ValueError):
    """A product file that contradicts another or lacks what it needs."""


def readable_products(texts: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """The files that read_products() accepts together, and why each other one is left out."""
    good: dict[str, str] = {}
    bad: dict[str, str] = {}
    for path, text in sorted(texts.items()):
        try:
            read_products(good | {path: text})
            good[path] = text
        except (ProductError, AttributeError, KeyError, TypeError) as e:
            bad[path] = str(e) or type(e).__name__
    return good, bad


def read_products(texts: dict[str, str]) -> dict[str, list[dict]]:
    """All product files of a repository by path -> rows of products, product_databases, declared, schedules.

    Both shapes are read: dependencies as code and tables or as product and reads; orchestration
    steps as a map or a list. A product or database that two files claim is an error.
    """
    out: dict[str, list[dict]] = {"products": [], "product_databases": [], "declared": [], "schedules": []}
    codes: dict[str, str] = {}
    databases: dict[str, str] = {}
    for path, text in sorted(texts.items()):
        try:
            doc = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ProductError(f"{path}: {' '.join(str(e).split())[:200]}") from None
        doc = doc.get("product", doc) if isinstance(doc, dict) and isinstance(doc.get("product"), dict) else doc
        code = (doc or {}).get("code") if isinstance(doc, dict) else None
        if not code:
            raise ProductError(f"{path}: a product needs a code")
        if code in codes:
            raise ProductError(f"{path}: product {code} is in {codes[code]} too")
        codes[code] = path
        owners = doc.get("owners") or doc.get("owner") or []
        out["products"].append({"code": code, "name": doc.get("name"), "domain": doc.get("domain"), "owners": owners if isinstance(owners, list) else [owners], "source_file": path})
        for db in doc.get("databases") or []:
            db = {"name": db} if isinstance(db, str) else db
            low = str(db["name"]).lower()
            if low in databases:
                raise ProductError(f"{path}: database {low} belongs to {databases[low]} too")
            databases[low] = code
            out["product_databases"].append({"name": db["name"], "product": code, "layer": db.get("layer")})
        for dep in doc.get("dependencies") or []:
            dep = {"code": dep} if isinstance(dep, str) else dep
            out["declared"].append({"product": code, "depends_on": dep.get("code") or dep.get("product"), "tables": list(dep.get("tables") or dep.get("reads") or [])})
        orch = doc.get("orchestration") or doc.get("orchestrator") or {}
        orch = orch if isinstance(orch, dict) else {}
        steps = orch.get("steps") or {}
        pairs = list(steps.items()) if isinstance(steps, dict) else [(s.get("name") or s.get("id"), s) for s in steps if isinstance(s, dict)]
        for step, body in [("__primary__", orch), *pairs]:
            when = (body or {}).get("schedule") or (body or {}).get("cron") if isinstance(body, dict) else body
            if when:
                out["schedules"].append({"id": f"product.{code}.{step}", "orchestrator": "product_yaml", "interval_text": str(when), "source_file": path, "line": 1})
    return out
