"""Query op3: digests of all conversations, read back from their formatted windows."""
from __future__ import annotations

from hashlib import sha256

import pyarrow as pa

from hazardlake.llm import chat
from hazardlake.llm.common import table

PROBE = "</s>[INST] ok [/INST]"
NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]


def op3_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"""select cast(-7 as bigint) as conv_id, turn, role, '{PROBE}' as text
                          from values (cast(0 as bigint), 'user'), (cast(1 as bigint), 'assistant') as t(turn, role)""")
    formatted = chat.windows(rows.unionByName(probe))

    def digests(batches):
        """The windows of a conversation follow each other: running digests, one row where it ends."""
        done: list = []
        state = None

        def close():
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]))

        for batch in batches:
            for conv, text, spans, again in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (
                    "conv_id", "formatted", "loss_spans", "n_repeated"))):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, sha256(), 0, sha256(), 0, 0]
                for role, body in chat.parse(text)[again:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for a, b in zip(spans[::2], spans[1::2]):
                    body = chat.unescape(text[a:b])
                    state[3] += len(body)
                    state[4].update(body.encode())
                state[5] += len(text)
                state[6] += 1
            if len(done) >= 10_000:
                yield _batch(done)
                done = []
        close()
        yield _batch(done)

    return formatted.select("conv_id", "formatted", "loss_spans", "n_repeated").mapInArrow(
        digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def _batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    cols = list(zip(*rows)) or [[] for _ in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=NAMES)
