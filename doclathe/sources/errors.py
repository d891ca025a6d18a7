"""Errors with a code and a phase, as the command line reports them."""

from __future__ import annotations


class EngineError(Exception):
    code = "GENERAL_ERROR"
    exit_code = 1

    def __init__(self, message: str, details: object = None):
        super().__init__(message)
        self.details = details

    def response(self, phase: str) -> dict:
        error = {"code": self.code, "message": str(self)}
        if self.details is not None:
            error["details"] = self.details
        if self.__cause__ is not None:
            error["cause"] = str(self.__cause__)
        return {"status": "error", "phase": phase, "error": error}


class SourceError(EngineError):
    code = "CONNECTION_ERROR"


class ConfigError(EngineError):
    code, exit_code = "CONFIG_ERROR", 2


class FileIOError(EngineError):
    code, exit_code = "FILE_IO_ERROR", 4


class ValidationError(EngineError):
    code = "VALIDATION_ERROR"


class InferenceError(EngineError):
    code = "INFERENCE_ERROR"


class SynthesisError(EngineError):
    code = "SYNTHESIS_ERROR"


class SamplingError(EngineError):
    code = "SAMPLING_ERROR"


class InputReadError(EngineError):
    code = "INPUT_READ_ERROR"
