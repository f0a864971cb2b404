"""Objects that a Python worker makes once and keeps from task to task."""

import sys
from types import ModuleType

HOLDER = "_newsmill_kept"


def kept(name, make):
    """The object of this name in this process; made by ``make`` when it is first asked for.

    Task functions arrive by value, with module globals of their own in every task, so what is to
    outlive a task stands in a module that is never sent.
    """
    held = sys.modules.setdefault(HOLDER, ModuleType(HOLDER)).__dict__
    if name not in held:
        held[name] = make()
    return held[name]
