from .expr import *  # noqa: F401,F403
