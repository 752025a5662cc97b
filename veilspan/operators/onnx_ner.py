"""A backend of ner.py that runs a token classifier in ONNX form; weights are the user's.

A folder holds model.onnx, tokenizer.json and labels.json (number of a label to its name: O, or B- or I- and a group).
"""

from __future__ import annotations

import json
import os

import numpy as np


def there(folder: str) -> bool:
    """Whether the folder has what Tagger reads."""
    return all(os.path.exists(os.path.join(folder, name)) for name in ("model.onnx", "tokenizer.json", "labels.json"))


class Tagger:
    """Built once in each worker, with one thread: Spark runs several of them on a machine."""

    def __init__(self, folder: str):
        import onnxruntime
        from tokenizers import Tokenizer

        with open(os.path.join(folder, "labels.json"), encoding="utf-8") as f:
            self.labels = {int(k): v for k, v in json.load(f).items()}
        self.tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        self.session = onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"), options, providers=["CPUExecutionProvider"])
        self.inputs = {i.name for i in self.session.get_inputs()}

    def count_tokens(self, text: str) -> int:
        return len(self.tokenizer.encode(text).ids)

    def tags(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, probability) of each token that has width."""
        coded = self.tokenizer.encode(text)
        given = {"input_ids": coded.ids, "attention_mask": coded.attention_mask, "token_type_ids": coded.type_ids}
        logits = self.session.run(None, {k: np.array([v], np.int64) for k, v in given.items() if k in self.inputs})[0][0]
        best = logits.max(axis=-1)
        sure = 1 / np.exp(logits - best[:, None]).sum(axis=-1)
        rows = zip(coded.offsets, logits.argmax(axis=-1).tolist(), sure.tolist(), strict=True)
        return [(a, b, self.labels[k], p) for (a, b), k, p in rows if a < b]

    def entities(self, text: str) -> list[dict]:
        """Neighbouring tokens of a group, as bio_entities() joins them."""
        found: list[tuple[str, int, int, list[float]]] = []
        open_ = False
        for start, end, label, p in self.tags(text):
            mark, _, group = label.partition("-")
            if open_ and mark == "I" and found[-1][0] == group and start <= found[-1][2] + 1:
                found[-1] = (group, found[-1][1], end, [*found[-1][3], p])
            elif label != "O":
                found.append((group, start, end, [p]))
            open_ = label != "O"
        return [{"entity_group": g, "start": a, "end": b, "word": text[a:b], "score": sum(ps) / len(ps)} for g, a, b, ps in found]
