"""Stand-ins for models, imported by name."""

import hashlib
import json


def encode(texts):
    return [[len(t) + 1.0, t.count("a") + 0.5, t.count(" ") + 0.25] for t in texts]


def label(prompt):
    return json.dumps({"name": hashlib.md5(prompt.encode()).hexdigest()[:6], "description": "d"}) if "x3" not in prompt.split("silent")[0] else "no idea"


def judge(prompt):
    return "1" if len(prompt) % 2 else "0"
