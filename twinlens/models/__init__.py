from .base import ModelBackend, Tokenizer
from .lexical import FunctionTokenizer, LexicalTokenizer, TiktokenTokenizer

__all__ = ["FunctionTokenizer", "LexicalTokenizer", "ModelBackend", "TiktokenTokenizer", "Tokenizer"]
