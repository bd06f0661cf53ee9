"""A row-at-a-time model of the contract, written from its text, to hold the plans against."""

import base64
import hashlib
import json

LATE = GAP = 1_800_000
WEEK = 604_800_000


def dumps(v):
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def sid(*parts):
    return sha(dumps(["1.0.0", *parts]))


def event(event_id, t, user="u1", kind="view", ingest=None, **payload):
    body = {"page_id": "home"} if kind != "purchase" else {"value_cents": 5}
    return {"schema_version": "1.0.0", "event_id": event_id, "source": "web", "user_id": user, "event_type": kind, "event_time_ms": t, "ingest_time_ms": t if ingest is None else ingest, "partition_key": user, "payload": body | payload}


def record(ev, seq, shard="s1", batch=0, position=0, key=None, text=None):
    text = base64.b64encode(dumps(ev).encode()).decode() if text is None else text
    return (batch, position, "arn:x", shard, str(seq), ev["partition_key"] if key is None else key, text)


class Model:
    def __init__(self, generation="live-v1"):
        self.g, self.ledger, self.top, self.version = generation, {}, {}, {}
        self.open, self.sessions, self.users, self.quarantine, self.work, self.told, self.commits = {}, {}, {}, {}, set(), [], {}

    def isolate(self, disposition, seq, digest):
        q = sid("quarantine", disposition, sha("arn:x"), seq, digest)
        self.quarantine.setdefault(q, (disposition, seq, digest))

    def islands(self, shard, user):
        rows = sorted((t, e) for e, (s, u, t, _, _) in self.open.items() if (s, u) == (shard, user))
        out = []
        for t, e in rows:
            if not out or t - out[-1][-1][0] > GAP:
                out.append([])
            out[-1].append((t, e))
        return out

    def apply(self, ev, shard, seq):
        digest = sha(dumps({k: v for k, v in ev.items() if k != "ingest_time_ms"}))
        known = self.ledger.get(ev["event_id"])
        if known:
            what = "EXPIRED_IDENTITY" if ev["ingest_time_ms"] - known[1] > WEEK else "IDENTICAL_DUPLICATE" if known[0] == digest else "IDENTITY_CONFLICT"
            if what != "IDENTICAL_DUPLICATE":
                self.isolate(what, seq, digest)
        else:
            t, top = ev["event_time_ms"], self.top.get(shard)
            what = "on_time" if top is None or t >= top else "accepted_late" if t >= top - LATE else "LATE_BEYOND_WATERMARK"
            self.ledger[ev["event_id"]] = (digest, ev["ingest_time_ms"])
            self.commits[sid("commit", self.g, ev["event_id"], digest)] = what
            if what == "LATE_BEYOND_WATERMARK":
                self.isolate(what, seq, digest)
            else:
                self.top[shard] = max(t, top if top is not None else t)
                self.version[shard] = self.version.get(shard, 0) + 1
                value = ev["payload"].get("value_cents")
                self.open[ev["event_id"]] = (shard, ev["user_id"], t, ev["event_type"], value)
                total = self.users.setdefault(ev["user_id"], [0, 0, 0, 0])
                total[["view", "click", "purchase"].index(ev["event_type"])] += 1
                total[3] += value or 0
                self.work.add((shard, self.top[shard] - LATE))
        self.told.append(what)
        self.close(shard)

    def close(self, shard):
        if shard not in self.top:
            return
        for user in {u for s, u, *_ in self.open.values() if s == shard}:
            for island in self.islands(shard, user):
                if self.top[shard] - LATE > island[-1][0] + GAP:
                    ids = sorted(e for _, e in island)
                    kinds = [self.open[e][3] for e in ids]
                    self.sessions[sid(self.g, user, ids)] = (user, island[0][0], island[-1][0], len(ids), dumps(ids), *(kinds.count(k) for k in ("view", "click", "purchase")), sum(self.open[e][4] or 0 for e in ids))
                    for e in ids:
                        del self.open[e]
