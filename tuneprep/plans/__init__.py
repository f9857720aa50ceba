from tuneprep.plans.ppo import ppo_prepare
from tuneprep.plans.reward import rm_evaluate, rm_prepare
from tuneprep.plans.sft import sft_prepare

__all__ = ["ppo_prepare", "rm_evaluate", "rm_prepare", "sft_prepare"]
