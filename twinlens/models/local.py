"""A backend for local transformers models; the libraries are needed only when one is made."""

from __future__ import annotations

import numpy as np

from ..errors import ClassificationModeError
from ..operators.validate import token_collisions
from .base import ModelBackend
from .lexical import FunctionTokenizer


class LocalTokenizer(FunctionTokenizer):
    def __init__(self, name: str, revision: str = "main"):
        from transformers import AutoTokenizer

        self.inner = AutoTokenizer.from_pretrained(name, revision=revision, padding_side="left")
        self.inner.pad_token = self.inner.pad_token or self.inner.eos_token
        super().__init__(lambda t: self.inner.encode(t, add_special_tokens=False), f"hf:{name}@{revision}")


class LocalModel(ModelBackend):
    """Greedy or seeded generation and next-token class scores, in batches of left-padded prompts."""

    def __init__(self, name: str, revision: str = "main", dtype: str = "float16", batch_size: int = 8, max_new_tokens: int = 512, class_prefix: str = " ", do_sample: bool = False, temperature: float = 1.0, device: str | None = None):
        import torch
        from transformers import AutoModelForCausalLM

        self.torch, self.batch_size, self.max_new_tokens, self.class_prefix = torch, batch_size, max_new_tokens, class_prefix
        self.do_sample, self.temperature = do_sample, temperature
        self.device = device or ("cuda" if torch.cuda.is_available() else "cpu")
        self.tokenizer = LocalTokenizer(name, revision)
        self.model = AutoModelForCausalLM.from_pretrained(name, revision=revision, torch_dtype=getattr(torch, dtype)).to(self.device).eval()
        self._id = f"hf:{name}@{revision}:{dtype}:n={max_new_tokens}:x={class_prefix!r}:s={do_sample}:t={temperature}"

    @property
    def cache_id(self) -> str:
        return self._id

    def _first(self, c: str) -> int | None:
        ids = self.tokenizer.encode(self.class_prefix + c)
        return ids[0] if ids else None

    def validate_classes(self, classes: list[str]) -> None:
        groups = token_collisions({c: self._first(c) for c in classes})
        if groups:
            raise ClassificationModeError(f"classes must differ in their first token: {groups}")

    def generate(self, prompts, seeds):
        torch, out = self.torch, []
        step = 1 if self.do_sample else self.batch_size  # a seed belongs to one prompt
        for k in range(0, len(prompts), step):
            x = self.tokenizer.inner(prompts[k : k + step], return_tensors="pt", padding=True).to(self.device)
            with torch.no_grad(), torch.random.fork_rng():
                if self.do_sample:
                    torch.manual_seed(seeds[k])
                y = self.model.generate(**x, max_new_tokens=self.max_new_tokens, do_sample=self.do_sample, temperature=self.temperature if self.do_sample else None, pad_token_id=self.tokenizer.inner.pad_token_id)
            out += self.tokenizer.inner.batch_decode(y[:, x["input_ids"].shape[1] :], skip_special_tokens=True)
        return out

    def score_classes(self, prompts, classes, seeds):
        torch, ids, out = self.torch, [self._first(c) for c in classes], []
        for k in range(0, len(prompts), self.batch_size):
            x = self.tokenizer.inner(prompts[k : k + self.batch_size], return_tensors="pt", padding=True).to(self.device)
            with torch.no_grad():
                logits = self.model(**x).logits[:, -1, :].float()
            out.append(torch.softmax(logits[:, ids], -1).cpu().numpy())
        return np.concatenate(out).astype(float) if out else np.zeros((0, len(classes)))

    def close(self) -> None:
        self.model = None
        if self.device != "cpu":
            self.torch.cuda.empty_cache()
