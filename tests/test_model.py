"""Random pipelines against a plain model that treats one record at a time."""

import json
import random
import re

import pytest

from catalog.steps import all_of, any_of, drop, enrich, field, grok, tag

ROWS = [
    ("x=1 y=22 x=3", 5, ["p", "q"], "2"),
    ("nothing here", None, None, "p"),
    ("", 0, [], None),
    ("x=7", 22, ["p", "p"], "x"),
    (None, -3, ["z"], ""),
]
SCHEMA = "a string, b long, list array<string>, c string"
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


class Model:
    def __init__(self, event):
        self.event, self.ctx = event, {}

    def find(self, name):
        at = self.event
        for key in name.split("."):
            at = at.get(key) if isinstance(at, dict) else None
        return at

    def text(self, name):
        value = self.find(name)
        if value is None:
            return self.ctx.get(name, "")
        if isinstance(value, list):
            return ",".join(json.dumps(v) for v in value)
        return json.dumps(value, separators=(",", ":")) if isinstance(value, dict) else str(value)

    def expand(self, template):
        return re.sub(r"\$\{([^${}]+)\}", lambda found: self.text(found[1]), template)

    def set(self, name, text, code):
        value = text
        if code[-1] == "n":
            value = int(float(text)) if NUMBER.fullmatch(text) else 0
        old = self.find(name)
        if code[0] == "a":
            if isinstance(old, list):
                value = [v for i, v in enumerate(old + [value]) if v not in (old + [value])[:i]]
            else:
                value = [value] if old is None else [old, value]
        *above, last = name.split(".")
        at = self.event
        for key in above:
            at = at.setdefault(key, {})
        at[last] = value

    def holds(self, test):
        if test is None:
            return True
        if test["class"] in ("any", "all"):
            return (any if test["class"] == "any" else all)([self.holds(t) for t in test["list"]])
        props = test["props"]
        if test["class"] == "field":
            texts = [self.text(props["name"])]
        else:
            tags = self.find("tags")
            texts = [t for t in tags if t == props["name"]] if isinstance(tags, list) else []
        wanted = any(re.search(props["is"], t) for t in texts) if "is" in props else True
        unwanted = any(re.search(props["isnot"], t) for t in texts) if "isnot" in props else False
        return wanted and not unwanted

    def run(self, step):
        """False when the record is dropped."""
        if not self.holds(step.get("condition")):
            return True
        props = step["props"]
        if step["class"] == "enrich":
            for f in props["fields"]:
                self.set(self.expand(f["name"]), self.expand(f["value"]), f.get("type", "s"))
            for t in props["tags"]:
                self.set("tags", self.expand(t), "as")
        elif step["class"] == "grok":
            lists = [props[k].split(",") for k in ("fields", "values", "types")]
            for found in list(re.finditer(props["pattern"], self.text(props["source"]))):
                self.ctx.update(zip(props["groups"].split(","), [g or "" for g in found.groups()]))
                for name, value, code in zip(*lists):
                    self.set(self.expand(name), self.expand(value), code)
        return step["class"] != "drop"


def random_test(rng, depth=0):
    kind = rng.choice(["field", "field", "tag", "any", "all"] if depth < 2 else ["field", "tag"])
    if kind in ("any", "all"):
        return (any_of if kind == "any" else all_of)(*[random_test(rng, depth + 1) for _ in range(rng.randint(0, 3))])
    patterns = ["^x", "p", "^(x|p)$", "[0-9]", "^$", ".", "^5$", "2$"]
    tests = {key: rng.choice(patterns) for key in rng.sample(["is_", "isnot"], rng.randint(0, 2))}
    if kind == "tag":
        return tag(rng.choice(["p", "x", "5"]), **tests)
    return field(rng.choice(["a", "b", "c", "o.p", "list", "k", "none"]), **tests)


def random_step(rng, dynamic):
    when = random_test(rng) if rng.random() < 0.5 else None
    kind = rng.choice(["enrich", "enrich", "grok", "grok", "drop"])
    names = ["a", "c", "d", "o.p", "o.q", "list", "n", "v"] + (["${c}z", "o.${k}r"] if dynamic else [])
    templates = ["${a}", "${b}", "${c}-${d}", "${k}", "${v}", "${o.p}${n}", "fixed", "5", "${list}", "${n}"]
    codes = ["s", "s", "n", "as", "an"]
    if kind == "drop":
        return drop(all_of(random_test(rng), random_test(rng)))
    count = rng.randint(1, 3)
    if kind == "enrich":
        fields = [(rng.choice(names), rng.choice(templates), rng.choice(codes)) for _ in range(count)]
        return enrich(*fields, tags=rng.sample(["p", "${c}", "${b}"], rng.randint(0, 2)), when=when)
    return grok(
        rng.choice(["a", "c", "d", "o.p"]),
        rng.choice([r"(\w)=(\d+)", r"([a-z])(\d)?", r"^(.)(.*)$"]),
        rng.choice(["k,v", "v,k", "d,v", "k"]),
        ",".join(rng.choice(names) for _ in range(count)),
        ",".join(rng.choice(templates) for _ in range(count)),
        ",".join(rng.choice(codes) for _ in range(count)),
        when,
    )


@pytest.mark.parametrize("seed", range(24))
def test_like_the_model(apply, seed):
    rng = random.Random(seed)
    steps = [random_step(rng, dynamic=seed % 3 == 0) for _ in range(rng.randint(1, 4))]
    expected = []
    for row in ROWS:
        model = Model({k: v for k, v in zip(["a", "b", "list", "c"], row) if v is not None})
        if all(model.run(step) for step in steps):
            expected.append(json.loads(json.dumps(model.event)))
    assert apply(ROWS, SCHEMA, steps) == expected, json.dumps(steps)
